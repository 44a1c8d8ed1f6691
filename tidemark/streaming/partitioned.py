"""Tables in parts, of which a merge rewrites only those that a batch touches, once for each batch whatever fails when.

A merge writes the new contents of the touched parts beside the table first. Only when they are complete does Spark's
dynamic partition overwrite put them in place of the old ones, and a mark says that the batch is in. A batch that comes again
after a failure finds one of three states: nothing complete (the table is as it was, so all is done again), complete contents
(they are put in place again), or the mark (nothing is left to do). So merges that add are as safe as those that replace.
One writer at a time; its batches have ascending numbers. A reader in the moment of the overwrite may see some parts before and some after the merge.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.facts import upsert
from ..operators.rollups import STATE, added, finished, sums
from ..staging import delete, exists

PART = "part"


def bucket(key: Sequence[str], buckets: int) -> Column:
    """The part of a row by a hash of its key, so that no key but one of equal rows fills a part."""
    return F.format_string("b%05d", F.pmod(F.xxhash64(*key), F.lit(buckets)))


def week_part(weeks: int, year: str = "year", week: str = "week") -> Column:
    """The part of a row by its week: so many weeks of a year together."""
    return F.format_string("%04d-%02d", year, F.floor((F.col(week) - 1) / weeks).cast("int"))


class PartitionedTable:
    """A table at `path` whose rows are dealt to parts by `part`, an expression over their columns that gives a string."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, part: Column):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if PART in self.schema.names:
            raise ValueError(f"a table in parts can't have a column {PART}")
        self._stored = T.StructType([*self.schema.fields, T.StructField(PART, T.StringType())])

    def _read(self, path: str) -> DataFrame:
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(path)

    def read(self, parts: Sequence[str] | None = None) -> DataFrame:
        """The table, or some of its parts; the others' files aren't opened."""
        rows = self._read(f"{self.path}/data")
        return (rows if parts is None else rows.where(F.col(PART).isin(list(parts)))).drop(PART)

    def conformed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])

    def touched(self, rows: DataFrame) -> list[str]:
        """The parts that rows would fall in: as many names at most as the table has parts."""
        return sorted(r[0] for r in rows.select(self.part.alias(PART)).distinct().collect())

    def applied(self, number: int) -> bool:
        """Whether this batch, or a later one, is in."""
        return number <= max(self._marks(), default=-1)

    def _marks(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/applied"):
            return []
        fs, p = self._fs(f"{self.path}/applied")
        return [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()]

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def merge(self, number: int, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
        """combine(old rows of the touched parts, rows) becomes their contents; the parts rewritten, none if the batch is in.

        combine must give no row of another part, and keep a row in each part (a part that is left empty would stay).
        """
        if self.applied(number):
            return []
        pending = f"{self.path}/pending-{number}"
        if not exists(self.spark, f"{pending}/_SUCCESS"):
            rows = self.conformed(rows)
            parts = self.touched(rows)
            merged = self.conformed(combine(self.read(parts), rows)).withColumn(PART, self.part)
            merged.repartition(PART).write.mode("overwrite").option("compression", "zstd").partitionBy(PART).parquet(pending)
        contents = self._read(pending)
        parts = sorted(r[0] for r in contents.select(PART).distinct().collect())
        if parts:
            contents.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(PART).parquet(f"{self.path}/data")
        self._mark(number)
        delete(self.spark, pending)
        return parts

    def _mark(self, number: int) -> None:
        before = self._marks()
        fs, p = self._fs(f"{self.path}/applied/{number}")
        fs.create(p, True).close()
        for n in before:
            if n != number:
                fs.delete(self._fs(f"{self.path}/applied/{n}")[1], False)


def facts_table(spark: SparkSession, path: str, schema: T.StructType | str, item: str, buckets: int = 64) -> PartitionedTable:
    """Facts dealt by their item, so all rows of an item are in one part and a hot entity is in all of them."""
    return PartitionedTable(spark, path, schema, bucket([item], buckets))


def merge_facts(facts: PartitionedTable, number: int, rows: DataFrame, key: Sequence[str], replace: Sequence[str] | None = None) -> list[str]:
    """Upserts rows by key (or a wider match, which must hold the item)."""
    return facts.merge(number, rows, lambda old, new: upsert(old, new, key, replace))


class IncrementalRollup:
    """Facts and the weekly sums above them, kept up to date batch by batch.

    A batch's facts replace those of the same key. What the sums change by (those of the new facts less those of the
    facts that they replace) is written first and then added to the weeks that it touches, so a week is never
    counted again from its facts. Weeks are stored in parts of `weeks` weeks of a year. Sums of measures are decimals, hence exact: subtracting undoes adding, in any order.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, item: str, key: Sequence[str], buckets: int = 64, weeks: int = 13):
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)
        self.facts = facts_table(spark, f"{self.root}/facts", schema, item, buckets)
        self.state = PartitionedTable(spark, f"{self.root}/weekly", STATE, week_part(weeks))

    def add(self, number: int, rows: DataFrame) -> dict[str, list[str]]:
        """Takes a batch in, once; the parts of facts and weeks that were rewritten."""
        change = f"{self.root}/change-{number}"
        if not self.state.applied(number) and not exists(self.spark, f"{change}/_SUCCESS"):
            new = self.facts.conformed(rows)
            old = self.facts.read(self.facts.touched(new)).join(new.select(*self.key).distinct(), self.key, "left_semi")
            both = added(sums(new, exact=True).unionByName(sums(old, exact=True, sign=-1)))
            both.write.mode("overwrite").parquet(change)
        weeks: list[str] = []
        if not self.state.applied(number):
            weeks = self.state.merge(number, self.spark.read.schema(T.StructType.fromDDL(STATE)).parquet(change), lambda old, new: added(old.unionByName(new)))
        parts = merge_facts(self.facts, number, rows, self.key)
        delete(self.spark, change)
        return {"facts": parts, "weeks": weeks}

    def weekly(self) -> DataFrame:
        """What `rollups.weekly` gives of all facts."""
        return finished(self.state.read().where("mention_count > 0"))

    def each(self, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For `run_available`: make turns a batch of the stream into facts."""
        return lambda batch, number: self.add(number, make(batch)) and None
