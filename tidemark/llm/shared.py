"""What the operators share: staged tables and size-checked broadcasts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..shipping import BATCH_BYTES, bounded
from ..staging import delete, exists, free_prefix, new_path, scope, shared_dir, staged  # noqa: F401  the operators take these from here

#: Rows and bytes, about, up to which a side of a join may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

#: ASCII white space between words, as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"


def in_batches(df: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """df, whose session from now on hands Python this package, and batches of bounded bytes."""
    bounded(df.sparkSession, batch_bytes)
    return df


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        flat = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType))
        each = F.greatest(F.size(c), F.lit(0)) * 8 if flat else F.coalesce(F.aggregate(F.transform(c, lambda x: _width(x, kind.elementType).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
        return each + 16
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows and `limit_bytes` bytes, else df itself (the join then shuffles).

    It is read for this, so stage it first if it is dear to compute.
    """
    size = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8))
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= limit_bytes else df


def from_files(docs: DataFrame, name: str = "docs") -> DataFrame:
    """docs if its rows come straight from files, so that they have `_metadata`, else a staged copy."""
    try:
        docs.select("_metadata.row_index", "_metadata.file_path").schema
        return docs
    except AnalysisException:  # no hidden columns
        return staged(docs, name)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, a plain scan of files, without the rows at gone's locators; columns as they were."""
    p = free_prefix(docs, "locator_")
    here = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.withColumn(f"{p}of", here).join(small(gone.select(F.col("locator").alias(f"{p}of"))), f"{p}of", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def most_frequent(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """The rows whose count is at or above the least threshold that at most `limit` rows reach.

    The threshold comes from a histogram (exact counts below 1024, 64 bins for each doubling above), so no sort or
    single task sees all rows. counts should be staged.
    """
    at = F.when(F.col(n) < 1024, F.col(n)).otherwise(1024 + F.floor(64 * F.log2(F.col(n) / 1024))).cast("long")
    left, least = limit, None
    for row in sorted(counts.groupBy(at.alias("bin")).count().collect(), key=lambda r: -r.bin):
        left -= row["count"]
        if left < 0:
            break
        least = row.bin
    return counts.where(at >= least) if least is not None else counts.limit(0)
