"""Files: the bronze layout, dictionaries, timelines, cases, the cache, and atomic tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.mentions import Alias, Entity
from ..schemas import conformed, ddl, empty, schema
from ..staging import free_prefix


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, through Spark, so from any store."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def bronze(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All files of a kind under root, at any depth; a typed empty table if there are none."""
    name = f"bronze_{kind}"
    if not exists(spark, root):
        return empty(spark, name)
    return spark.read.schema(schema(name)).option("recursiveFileLookup", "true").option("pathGlobFilter", f"{kind}.*.parquet").parquet(root)


def append_bronze(df: DataFrame, root: str, kind: str) -> None:
    """A partitioned append: by day of retrieval, source and kind; the writer's own names keep files apart."""
    rows = conformed(df, f"bronze_{kind}").withColumns({"ingest_date": F.to_date("retrieved_at"), "source": F.col("_source"), "kind": F.lit(kind)})
    rows.write.mode("append").partitionBy("kind", "ingest_date", "source").option("compression", "zstd").parquet(root)


def partitioned_bronze(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """What `append_bronze` wrote; filters on ingest_date and source prune."""
    if not exists(spark, f"{root}/kind={kind}"):
        return empty(spark, f"bronze_{kind}")
    return spark.read.schema(ddl(f"bronze_{kind}") + ", kind string, ingest_date date, source string").parquet(root).where(F.col("kind") == kind)


_POINTER = "CURRENT"


def _pointed(spark: SparkSession, folder: str) -> str | None:
    return read_text(spark, f"{folder}/{_POINTER}").strip() if exists(spark, f"{folder}/{_POINTER}") else None


def _point(spark: SparkSession, folder: str, text: str) -> None:
    """Writes a pointer beside the one that counts, and renames it over that one."""
    fs, new = _fs(spark, f"{folder}/.{_POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    target = fs.makeQualified(_fs(spark, f"{folder}/{_POINTER}")[1])
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), target, options)


def _keep_versions(spark: SparkSession, folder: str, kept: set[str]) -> None:
    """Deletes the versions of a table but those named."""
    if not exists(spark, folder):
        return
    fs, path = _fs(spark, folder)
    for status in fs.listStatus(path):
        if (found := status.getPath().getName()).startswith("v-") and found not in kept:
            fs.delete(status.getPath(), True)


def _has_versions(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds versions, such as those of a writer that failed before any was published."""
    fs, path = _fs(spark, folder)
    return any(s.getPath().getName().startswith("v-") for s in fs.listStatus(path))


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """The versions of the tables that were published together under root, by name; empty if none were."""
    text = _pointed(spark, root)
    return json.loads(text)["now"] if text else {}


def current(spark: SparkSession, root: str, name: str) -> str | None:
    """The folder of a table's version: that of the published set, else that which its own pointer names, else the
    table's own folder if it has no pointer; null if there's none."""
    path, version = f"{root}/{name}", published(spark, root).get(name)
    if version or (version := _pointed(spark, path)):
        return f"{path}/{version}"
    return path if exists(spark, path) and not _has_versions(spark, path) else None


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A declared table as it is now; a typed empty one if it isn't there."""
    path = current(spark, root, name)
    return spark.read.schema(schema(name)).parquet(path) if path else empty(spark, name)


class Publication:
    """Versions of tables under root that nobody sees until all of them are published."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.versions = spark, root, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a new version of a table; gives it, read again."""
        version = f"v-{uuid.uuid4().hex}"
        conformed(df, name).write.option("compression", "zstd").parquet(f"{self.root}/{name}/{version}")
        self.versions[name] = version
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        """The new version of a table, if there's one, else what readers see."""
        if name in self.versions:
            return self.spark.read.schema(schema(name)).parquet(f"{self.root}/{name}/{self.versions[name]}")
        return table(self.spark, self.root, name)


@contextmanager
def publication(spark: SparkSession, root: str) -> Iterator[Publication]:
    """Publishes what is written within it in one step, if it ends well; else readers go on with the set before.

    One pointer names the versions of all tables of the set, and is renamed over the one before, so readers never see tables of two
    sets. The set before stays for frames that still read it. There is one writer to a root at a time; the
    rename is one step on file systems, and not on object stores without renames.
    """
    p = Publication(spark, root)
    text = _pointed(spark, root)
    before = json.loads(text)["now"] if text else {}
    try:
        yield p
    except BaseException:
        for name, version in p.versions.items():
            fs, path = _fs(spark, f"{root}/{name}/{version}")
            fs.delete(path, True)
        raise
    if p.versions:
        now = {**before, **p.versions}
        _point(spark, root, json.dumps({"now": now, "before": before}, sort_keys=True))
        for name in p.versions:
            own = _pointed(spark, f"{root}/{name}")  # a table that had a pointer of its own
            _keep_versions(spark, f"{root}/{name}", {now[name], before.get(name, own or "")})


def replace_table(df: DataFrame, root: str, name: str) -> None:
    """Writes a version beside the others, then renames a pointer over the old one in one step of the file system.

    So a reader finds the old version or the new one, also after a crash at any point, and a table may be read to make
    itself. The version before is kept for frames that still read it; older ones and leftovers go, so a table has one
    writer at a time. A table of a published set is published again with the set's others as they are.
    """
    spark, path = df.sparkSession, f"{root}/{name}"
    if name in published(spark, root):
        with publication(spark, root) as p:
            p.write(df, name)
        return
    before, version = _pointed(spark, path), f"v-{uuid.uuid4().hex}"
    conformed(df, name).write.option("compression", "zstd").parquet(f"{path}/{version}")
    _point(spark, path, version)
    _keep_versions(spark, path, {version, before or ""})


def _load(text: str, path: str):
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML isn't installed; give the file as JSON") from e
    return yaml.safe_load(text)


def dictionary(spark: SparkSession, path: str) -> list[Entity]:
    """Entities in their file's order, with checked aliases."""
    return [Entity(d["id"], tuple(Alias(a["string"], a.get("mode", "substring"), float(a.get("weight", 1.0))) for a in d.get("aliases") or ()), *[d.get(k) or "" for k in ("display_name", "role", "affiliation", "status")], d.get("notes")) for d in _load(read_text(spark, path), path)]


def dim_character(spark: SparkSession, entities: Iterable[Entity]) -> DataFrame:
    rows = [(e.id, e.display_name, e.role, e.affiliation, e.status, len(e.aliases), e.notes or "") for e in entities]
    return spark.createDataFrame(rows, schema("dim_character"))


def dim_of(rows: DataFrame) -> DataFrame:
    """dim_character of a dictionary in a table: id, aliases (an array), and whatever it has of the other fields; absent ones are empty."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    own = rows.withColumns({"character_id": F.col("id"), "alias_count": F.when(F.col("aliases").isNull(), 0).otherwise(F.size("aliases"))})
    return conformed(own.select("character_id", "alias_count", *[field(c).alias(c) for c in ("display_name", "role", "affiliation", "status", "notes")]), "dim_character")


def alias_table(spark: SparkSession, entities: Iterable[Entity]) -> DataFrame:
    rows = [(e.id, pos, a.string, a.mode, float(a.weight)) for e in entities for pos, a in enumerate(e.aliases)]
    return spark.createDataFrame(rows, "character_id string, pos int, alias string, mode string, weight double")


def events(spark: SparkSession, path: str) -> DataFrame:
    """dim_event with pos, the place in the file; dates become midnight in UTC."""
    rows = []
    for pos, e in enumerate(_load(read_text(spark, path), path) or []):
        day = e["date"]
        day = day.isoformat() if isinstance(day, date | datetime) else str(day)
        rows.append((e["id"], day, e.get("chapter"), e.get("arc") or "", e.get("title") or "", e.get("description") or "", e.get("spoiler_intensity") or "", e.get("medium") or "", bool(e.get("verified", False)), list(e.get("characters") or []), pos))
    kind = ddl("dim_event").replace("event_date timestamp", "event_date string") + ", pos int"
    return spark.createDataFrame(rows, kind).withColumn("event_date", F.to_timestamp("event_date"))


def event_windows(timeline: DataFrame, days: int = 7, verified_only: bool = False) -> DataFrame:
    """event_id, after, before (epoch seconds) of the days around each event."""
    rows = timeline.where("verified") if verified_only else timeline
    at = F.unix_timestamp("event_date")
    return rows.select("event_id", (at - days * 86_400).alias("after"), (at + days * 86_400).alias("before"))


#: Seconds of a bin of times.
BIN_SECONDS = 86_400


def in_windows(items: DataFrame, windows: DataFrame, at: str = "created_utc", seconds: int = BIN_SECONDS) -> DataFrame:
    """Items within some window [after, before), once each, however many windows there are and however they overlap.

    Time is cut in bins; a window goes to each bin that it meets, an item to its own, and the join is by bin, with the
    bounds checked within. So neither side meets all of the other, nothing is broadcast unchecked, and a hot bin's items can be
    split among tasks. Windows with the same bounds are taken once; one of no length holds nothing. Wide windows want wider bins.
    """
    p = free_prefix(items, "window_")
    first, last = F.floor(F.col("after") / seconds), F.floor((F.col("before") - 1) / seconds)
    parts = windows.select("after", "before").distinct().where(F.col("before") > F.col("after")).select(F.explode(F.sequence(first, last)).alias(f"{p}bin"), F.col("after").alias(f"{p}after"), F.col("before").alias(f"{p}before"))
    here = items.withColumn(f"{p}of", F.floor(F.col(at) / seconds))
    inside = (F.col(f"{p}of") == F.col(f"{p}bin")) & (F.col(at) >= F.col(f"{p}after")) & (F.col(at) < F.col(f"{p}before"))
    return here.join(parts, inside, "left_semi").drop(f"{p}of")


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, category, text, expected_<axis>; blank lines are skipped."""
    rows = spark.read.schema(schema("eval_case")).json(path).where("id is not null")
    return rows.select("id", "category", "text", *[F.col(f"expected.{x}").alias(f"expected_{x}") for x in ("sentiment", "intensity", "target")])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line and place of every line of text files, however they are split: place orders lines as they were written.

    Files come by their time, then by name; within a file a split by its first byte, and within a split Spark reads lines in order.
    """
    meta = F.col("_metadata")
    place = F.struct(meta["file_modification_time"].alias("written"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("value").alias("line"), place.alias("place"))


def cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's lines; malformed ones are skipped and the last line of a key counts, whatever time it has."""
    if not exists(spark, path):
        return empty(spark, "cache")
    lines = numbered_lines(spark, path).select(F.from_json("line", schema("cache")).alias("c"), "place").where("c.key is not null and c.result is not null")
    last = lines.groupBy("c.key").agg(F.max_by(F.struct("c.result", "c.cached_at"), "place").alias("r"))
    return last.select("key", "r.result", "r.cached_at")


def append_cache(fresh: DataFrame, path: str) -> None:
    conformed(fresh, "cache").write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").text(path)


def inventory(spark: SparkSession, root: str, suffix: str = "*.parquet") -> DataFrame:
    """Files and bytes under root, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(root)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def status(spark: SparkSession, layers: dict[str, str], cache_path: str | None = None) -> DataFrame:
    """layer, files, bytes of each layer's folder that there is, and of the cache its lines."""
    parts = [inventory(spark, path).select(F.lit(layer).alias("layer"), "files", "bytes", F.lit(None).cast("long").alias("lines")) for layer, path in layers.items() if exists(spark, path)]
    if cache_path and exists(spark, cache_path):
        lines = spark.read.text(cache_path).agg(F.count("*").alias("lines"))
        parts.append(inventory(spark, cache_path, "part-*").crossJoin(F.broadcast(lines)).select(F.lit("cache").alias("layer"), "files", "bytes", "lines"))
    out = spark.createDataFrame([], "layer string, files long, bytes long, lines long")
    for p in parts:
        out = out.unionByName(p)
    return out


def register(spark: SparkSession, root: str, names: Iterable[str]) -> None:
    """A temporary view for each gold table."""
    for n in names:
        table(spark, root, n).createOrReplaceTempView(n)
