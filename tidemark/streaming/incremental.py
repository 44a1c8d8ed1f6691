"""Incremental runs: files that are new since the last one, merged into tables, and high-water marks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.facts import upsert
from ..operators.silver import latest
from ..schemas import conformed, schema
from ..sources.files import replace_table, table


def new_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """A stream of a kind's bronze files; the checkpoint is the ledger of those processed."""
    return spark.readStream.schema(schema(f"bronze_{kind}")).option("recursiveFileLookup", "true").option("pathGlobFilter", f"{kind}.*.parquet").parquet(root)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def merge_silver(root: str, name: str, normalise: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch's rows into silver: of each id the latest retrieved stays, so repeats and overlaps do no harm."""

    def each(batch: DataFrame, number: int) -> None:
        old = table(batch.sparkSession, root, name)
        both = old.withColumn("__new", F.lit(1)).unionByName(conformed(normalise(batch), name).withColumn("__new", F.lit(0)))
        replace_table(latest(both, "id", "retrieved_at", (F.col("__new"),)).drop("__new"), root, name)

    return each


def merge_facts(root: str, name: str, key: Sequence[str], make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def each(batch: DataFrame, number: int) -> None:
        replace_table(upsert(table(batch.sparkSession, root, name), conformed(make(batch), name), key), root, name)

    return each


def advance_marks(marks: DataFrame, rows: DataFrame, keys: Sequence[str] = ("subreddit", "kind"), at: str = "created_utc") -> DataFrame:
    """The greatest mark of each key; one never falls."""
    new = rows.groupBy(*keys).agg(F.max(at).alias("mark"))
    return marks.select(*keys, "mark").unionByName(new).groupBy(*keys).agg(F.max("mark").alias("mark"))


def above_marks(rows: DataFrame, marks: DataFrame, keys: Sequence[str] = ("subreddit", "kind"), at: str = "created_utc") -> DataFrame:
    """Rows above their key's mark; a key without one has mark 0."""
    known = marks.select(*keys, F.col("mark").alias("__mark"))
    return rows.join(known, list(keys), "left").where(F.col(at) > F.coalesce("__mark", F.lit(0))).drop("__mark")


def changed_weeks(facts: DataFrame, batch: DataFrame, entity: str = "character_id") -> DataFrame:
    """The facts of the (entity, week) pairs that a batch touches: what a rollup needs to be brought up to date."""
    week = F.date_trunc("week", "created_at")
    touched = batch.select(entity, week.alias("__week")).distinct()
    return facts.withColumn("__week", week).join(touched, [entity, "__week"], "left_semi").drop("__week")
