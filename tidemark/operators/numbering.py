"""A global row number over any number of rows: sorted ranges, counted, with the counts before each added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..staging import free_prefix, staged

#: Bits of a row's place within its range, as monotonically_increasing_id lays them out.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`, 1, 2, 3 ... by `order`, which should be a complete key (rows that tie are numbered in any order).

    The rows are dealt in ranges of the key and sorted within them, in as many tasks as the shuffle has partitions. They
    are staged with their place, so that it can't change when a task runs again; then the ranges are counted, which
    gives the driver one number for each range. Rows of one key value are in one range, so the key should tell them apart.
    """
    spark, p = df.sparkSession, free_prefix(df, "numbering_")
    at, part = f"{p}at", f"{p}part"
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(part, F.shiftright(at, _PLACE_BITS))
    before, offsets = 0, []
    for r in rows.groupBy(part).count().orderBy(part).collect():
        offsets.append((r[0], before))
        before += r[1]
    starts = F.broadcast(spark.createDataFrame(offsets, f"{part} long, {p}before long"))
    place = F.col(at).bitwiseAND((1 << _PLACE_BITS) - 1)
    return rows.join(starts, part).withColumn(name, F.col(f"{p}before") + place + 1).select(*[F.col(f"`{c}`") for c in df.columns], name)
