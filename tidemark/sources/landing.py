"""Runs of a live feed, asked for by tasks and kept as they came, so that all that follows can be done again.

A feed moves on: what is asked for twice isn't the same. So a run asks each community in a task of its own, and writes what is
above the community's mark before anything else sees it. A run counts once its table is complete; one that fails
before is asked for anew, as nothing of it was used, and one that is complete is never asked for again. What follows reads the runs as a
stream of files, whose checkpoint tells which are done. Marks are the greatest times of the runs; they never fall.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.classify import paced
from ..schemas import ddl
from ..shipping import ship
from ..staging import exists
from .archive import seconds
from .live import NEWEST, PER_SECOND, comments_of, from_folder, get_json, newer, newest

LANDED = f"{ddl('bronze_posts')}, community string, mark long"
_MARKS = "community string, mark long"


def runs(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the complete runs below a folder."""
    if not exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(int(n[4:]) for n in names if n.startswith("run=") and exists(spark, f"{folder}/{n}/_SUCCESS"))


def marks(spark: SparkSession, root: str) -> DataFrame:
    """community, mark after the last complete run: the marks that it wrote, or those before and its rows."""
    done, written = runs(spark, f"{root}/posts"), runs(spark, f"{root}/marks")
    last = max((n for n in written if n in done), default=None)
    parts = [spark.read.schema(_MARKS).parquet(f"{root}/marks/run={last}")] if last is not None else []
    parts += [spark.read.schema(LANDED).parquet(f"{root}/posts/run={n}").select("community", "mark") for n in done if last is None or n > last]
    out = spark.createDataFrame([], _MARKS)
    for p in parts:
        out = out.unionByName(p)
    return out.groupBy("community").agg(F.max("mark").alias("mark"))


def land_posts(spark: SparkSession, root: str, communities: str, options: dict, limit: int = NEWEST) -> int:
    """Asks for the newest posts of each community, a task for each, and lands those above its mark; the run's number.

    A community whose feed fails is left to the next run.
    """
    ship(spark)
    names = [c.strip() for c in communities.split(",") if c.strip()]
    number = max(runs(spark, f"{root}/posts"), default=-1) + 1
    known = marks(spark, root)
    fields = [f.split()[0] for f in ddl("bronze_posts").split(", ")]
    asked = spark.createDataFrame([(c,) for c in names], "community string").join(F.broadcast(known), "community", "left").select("community", F.coalesce("mark", F.lit(0)).alias("mark")).repartition(max(1, len(names)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for community, mark in zip(batch["community"], batch["mark"], strict=True):
                try:
                    feed = newest(get_json(options, paced(PER_SECOND / max(1, len(names)))), community, limit) if options.get("url") else from_folder(options["path"], "posts", community)
                except (OSError, ValueError, KeyError):
                    continue
                found, _ = newer(feed, int(mark), limit)
                rows += [(*(seconds(r) if f == "created_utc" else None if f == "retrieved_at" else r.get(f) for f in fields), community, seconds(r)) for r in found]
            yield pd.DataFrame(rows, columns=[*fields, "community", "mark"])

    rows = asked.mapInPandas(run, LANDED).withColumn("retrieved_at", F.current_timestamp())
    rows.write.mode("overwrite").parquet(f"{root}/posts/run={number}")
    # read again, so these are the rows that landed
    marks(spark, root).coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/run={number}")
    return number


def landed_posts(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the landed posts; the checkpoint of what reads it is the ledger of the runs that are done."""
    return spark.readStream.schema(LANDED).option("recursiveFileLookup", "true").parquet(f"{root}/posts").drop("community", "mark")


def land_comments(posts: DataFrame, root: str, number: int, options: dict, tasks: int = 4) -> DataFrame:
    """The comments of a batch's posts, asked for once: a batch that is run again reads what it landed."""
    spark, path = posts.sparkSession, f"{root}/comments/run={number}"
    if not exists(spark, f"{path}/_SUCCESS"):
        comments_of(posts, options, tasks).withColumn("retrieved_at", F.current_timestamp()).write.mode("overwrite").parquet(path)
    return spark.read.schema(ddl("bronze_comments")).parquet(path)
