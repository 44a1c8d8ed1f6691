"""Exact duplicates by a stateful streaming aggregation with disk-backed state.

The state (RocksDB, checkpointed in the shared folder, no watermark, hence no expiry) keeps for each digest of
a normalised text the smallest (stable identifier, content locator) and the number of rows seen. Every row of a
digest seen before is a hit: in the batch that makes it one, its whole text is compared byte by byte with the text at the
kept locator, also when the stream goes on later and another row comes to stay; rows
that differ in spite of equal digests are noted, and regrouped by their texts. The rows of a large group are compared in
parts of GROUP_ROWS, each with a copy of the kept text, so that no group fills a task.

Defined results: null text counts as empty, and all empty texts are equal; a row without identifier stays only if no row
of its group has one; of rows with the same identifier and
text the one with the smaller locator stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import SPACE, exists, from_files, new_path, small, staged, without

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = "doc_id long, locator struct<file: string, row: long>, digest string"
_KEEP = "struct<none: boolean, doc_id: long, locator: struct<file: string, row: long>>"
#: Rows of a group that one task compares.
GROUP_ROWS = 1_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: Files of a store aren't allocated ahead: with many small stores this would take megabytes each.
STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


@contextmanager
def _rocksdb(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _place() -> Column:
    """What the smallest of a group is told by; a null identifier comes after all others."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")


class StreamingDeduplicator:
    """Keyed state over an inbox of (doc_id, locator, digest) rows; restarts continue from the checkpoint.

    `add` appends keys to the inbox, `advance` runs the stream over what is new and checks its hits, `groups` gives for each
    digest the row that stays and the number of rows, `differing` the rows whose bytes aren't those of the row that stays.
    `root` (in shared storage) holds inbox, state and results.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, max_bytes_per_trigger: int = 16 << 30):
        self.spark, self.root, self.max_bytes = spark, root or new_path(spark, "dedup"), max_bytes_per_trigger

    def add(self, keys: DataFrame) -> None:
        keys.write.mode("append").parquet(f"{self.root}/inbox")

    def keys(self) -> DataFrame:
        return self.spark.read.schema(KEYS).parquet(f"{self.root}/inbox")

    def advance(self, texts: DataFrame) -> None:
        """texts: locator, norm of every row that was ever added."""

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.root}/groups/batch={number}")
            self._check(number, texts)

        with _rocksdb(self.spark):
            stream = self.spark.readStream.schema(KEYS).option("maxBytesPerTrigger", self.max_bytes).parquet(f"{self.root}/inbox")
            state = stream.groupBy("digest").agg(F.min(_place()).alias("keep"), F.count("*").alias("n"))
            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
            query.awaitTermination()

    def _check(self, number: int, texts: DataFrame) -> None:
        """Compares the whole texts of the hits of a batch; a batch that is run again writes the same again.

        A row is compared once, with the row that stays then. When another row comes to stay, the one that stayed before is
        compared with it. If they are alike, what was found holds; if not, all rows of the group are compared with the new one.
        """
        hits = self._groups().where((F.col("batch") == number) & (F.col("n") > 1)).select("digest", F.col("keep.locator").alias("stay"), "n")
        members = self.keys().join(small(hits), "digest").where(F.col("locator") != F.col("stay"))
        checked = exists(self.spark, f"{self.root}/checked")
        before = self._checked().where(F.col("batch") < number).select("locator").distinct() if checked else None
        self._compare(members.join(small(before), "locator", "left_anti") if checked else members, texts, f"batch={number}/step=0")
        if not checked:
            return
        stayed = self._groups().where(F.col("batch") < number).groupBy("digest").agg(F.min("keep").alias("keep")).select("digest", F.col("keep.locator").alias("locator"))
        unlike = self._checked().where((F.col("batch") == number) & (F.col("step") == 0) & ~F.col("equal"))
        turned = staged(unlike.join(stayed, ["digest", "locator"]).select("digest").distinct(), "dedup-turned")
        if not turned.isEmpty():
            self._compare(members.join(small(turned), "digest").join(small(before), "locator", "left_semi"), texts, f"batch={number}/step=1")

    def _compare(self, members: DataFrame, texts: DataFrame, name: str) -> None:
        """Whether each member's text is that of the row at `stay`."""
        parts = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
        members = staged(members.select("locator", "digest", "stay", parts.alias("parts"), F.pmod(F.xxhash64("locator"), parts).cast("int").alias("part")), "dedup-members")
        stays = members.select("stay", "digest", "parts").distinct()
        wanted = staged(members.select("locator", "digest", "part", F.lit(False).alias("stays")).union(stays.select("stay", "digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.lit(True))), "dedup-wanted")
        found = texts.join(small(wanted), "locator")
        stay = found.where("stays").select("digest", "part", F.col("norm").alias("stay"))
        compared = found.where("not stays").join(stay, ["digest", "part"])
        compared.select("locator", "digest", F.col("norm").eqNullSafe(F.col("stay")).alias("equal")).write.mode("overwrite").parquet(f"{self.root}/checked/{name}")

    def _checked(self) -> DataFrame:
        return self.spark.read.schema("locator struct<file: string, row: long>, digest string, equal boolean, batch long, step int").parquet(f"{self.root}/checked")

    def differing(self) -> DataFrame:
        """locator, digest of the rows whose bytes aren't those of the row that stays."""
        if not exists(self.spark, f"{self.root}/checked"):
            return self.spark.createDataFrame([], "locator struct<file: string, row: long>, digest string")
        rows = self._checked()
        if not rows.where("step > 0").isEmpty():  # some rows were compared again: the last time counts
            rows = rows.groupBy("locator", "digest").agg(F.max_by("equal", F.struct("batch", "step")).alias("equal"))
        return rows.where("not equal").select("locator", "digest")

    def _groups(self) -> DataFrame:
        return self.spark.read.schema(f"digest string, keep {_KEEP}, n long, batch long").parquet(f"{self.root}/groups")

    def groups(self) -> DataFrame:
        if not exists(self.spark, f"{self.root}/groups"):  # nothing has arrived yet
            return self.spark.createDataFrame([], f"digest string, keep {_KEEP}, n long")
        return self._groups().groupBy("digest").agg(F.min("keep").alias("keep"), F.max("n").alias("n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and locator for every row of docs.

    digest maps the normalised text to the key of the state; a weak one only makes more hits to check.
    """
    spark = docs.sparkSession
    docs = from_files(docs).select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))
    state = StreamingDeduplicator(spark)
    # the digest that is reported is always SHA-256; the key of the state may be another
    full = digest is sha256_of
    state.add(docs.select("doc_id", "locator", digest(F.col("norm")).cast("string").alias("digest"), *([] if full else [sha256_of(F.col("norm")).alias("sha")])))
    state.advance(docs.select("locator", "norm"))
    keys = state.keys() if full else spark.read.schema(KEYS + ", sha string").parquet(f"{state.root}/inbox")
    # a row that is alone stays; so only groups are joined, staged, as a hot one can then be split
    groups = staged(state.groups().where("n > 1"), "dedup-groups")
    rows = keys.withColumn("place", _place()).join(small(groups), "digest", "left")
    rows = rows.withColumns({"kept": F.col("keep").isNull() | (F.col("place") == F.col("keep")), "n": F.coalesce("n", F.lit(1)), "keep_id": F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))})
    out = rows.select("doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), "kept", F.col("digest" if full else "sha").alias("text_sha256"), "locator", "digest")
    differ = staged(state.differing(), "dedup-differ")
    if differ.isEmpty():
        return out.drop("digest")
    differ = staged(docs.join(small(differ), "locator"), "dedup-differ")
    w = Window.partitionBy("digest", "norm")
    regrouped = differ.withColumn("keep", F.min(_place()).over(w)).withColumn("m", F.count("*").over(w)).select("locator", F.col("keep.doc_id").alias("new_keep"), "m", (_place() == F.col("keep")).alias("new_kept"))
    gone = differ.groupBy("digest").agg(F.count("*").alias("less"))
    out = out.join(regrouped, "locator", "left").join(gone, "digest", "left")
    new = F.col("m").isNotNull()
    return out.select("doc_id", F.when(new, F.col("new_keep")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("m", F.col("group_size") - F.coalesce("less", F.lit(0))).alias("group_size"), F.coalesce("new_kept", "kept").alias("kept"), "text_sha256", "locator")


def drop_exact_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """docs without the rows that `exact_duplicates` doesn't keep; columns as they were."""
    docs = from_files(docs)
    return without(docs, staged(exact_duplicates(docs, **kw).where("not kept").select("locator"), "dedup-gone"))
