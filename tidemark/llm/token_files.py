"""Flat files of token ids: written by Spark's own writer, and scanned for separators.

A file is nothing but little-endian unsigned 16-bit ids; each document's ids are followed by the end id, which no
text has. There is no index: a file's ids are one text value whose bytes Spark writes as they are, and the end id is its
line separator, so any store that Spark writes will do.

One pass over the documents writes every file twice over: its ids in `kind=ids/folder=<number>`, and beside them, in
`kind=docs/folder=<number>`, the identifiers of the documents in it. A folder has the files of FOLDER_TASKS tasks, so a store
lists few folders. A file's number comes from the task and the file's place in it, both of which Spark's writer puts in its name
(`part-<task>-...c<place>`): it writes one row to a file, and the rows are sorted by their place. The file of identifiers
holds its number too, and one that stands elsewhere is an error.
A task that is run again writes both again, and both are committed by one write, so they can't part, however the scan is
cut and whichever executors are lost. A file gets FILE_BYTES of ids and the rest of the document that crosses them.

The scan reads whole files and searches blocks of BLOCK ids for the
end id at once. A block gives the places of its ends. A document that began in an earlier block is stitched by a
prefix scan over the blocks of a file: the running maximum of the last end before a block, and the running sum of
the ends before it, which is the number of its first document in the file. Numbered documents meet their identifiers by
file and number; one without a partner on either side is an error.

Defined results: null text is empty; an empty text is just an end; ids at the end of a file after its last end are a
document that isn't finished, and are given with `finished` false; an id beyond 16 bits, or the end id within a text, is
an error; null identifiers are kept; repeated rows are documents of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .packing import codec, encoded, narrow
from .shared import in_batches, new_path

END = 50_256
BLOCK = 1 << 20
#: Bytes of ids after which a file is closed.
FILE_BYTES = 8 << 20
#: Tasks whose files share a folder.
FOLDER_TASKS = 64


def separator(end: int = END) -> dict[str, str]:
    """Options of Spark's text writer by which it ends each row with the end id."""
    return {"lineSep": np.array([end], "<u2").tobytes().decode("latin-1"), "encoding": "ISO-8859-1"}


def write(docs: DataFrame, path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, end: int = END) -> None:
    """Every row of docs to flat files under path, and whose ids these are; nothing is shuffled."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number, tail = codec(ranks_path, pattern), TaskContext.get().partitionId() << 32, np.array([end], "<u2").tobytes()
        docs, parts, size = [], [], 0

        def file() -> pa.RecordBatch:
            known = np.array([d is not None for d in docs], np.uint8).tobytes()
            held = np.array([number], "<i8").tobytes() + known + np.array([d or 0 for d in docs], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array(["ids", "docs"]), pa.array([number, number], pa.int64()), pa.array([tail.join(parts), held], pa.binary())], names=["kind", "file", "value"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = narrow(encoded(enc, text.as_py()))
                if (ids == end).any():
                    raise ValueError(f"document {doc} has the end id {end} within it")
                docs.append(doc)
                parts.append(ids.tobytes())
                size += 2 * len(ids) + 2
                if size >= file_bytes:
                    yield file()
                    number, docs, parts, size = number + 1, [], [], 0
        if docs:
            yield file()

    source = in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    files = source.mapInArrow(fill, "kind string, file long, value binary")
    # a kind that may be null would be written by an expression of its own, which the order below doesn't cover
    files = files.select(F.coalesce("kind", F.lit("ids")).alias("kind"), F.shiftright("file", 32).cast("int").alias("task"), "file", F.col("value").cast("string").alias("value"))
    ordered = files.withColumn("folder", F.floor(F.col("task") / FOLDER_TASKS).cast("int")).sortWithinPartitions("kind", "folder", "file")
    ordered.select("kind", "folder", "value").write.options(**separator(end), maxRecordsPerFile=1).partitionBy("kind", "folder").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files under path that Spark's writer has made."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _number(path: str) -> int | None:
    m = re.search(r"/part-(\d+)-[^/]*\.c(\d+)(?:\.[^/]*)?$", path)
    return (int(m[1]) << 32) + int(m[2]) if m else None


def identifiers(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, doc_id of every document that `write` has put under path."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()[:-2]  # the writer ends each value
                if int.from_bytes(raw[:8], "little") != _number(name):
                    raise ValueError(f"{name} holds the identifiers of another file")
                raw = raw[8:]
                n = len(raw) // 9
                docs = pa.array(np.frombuffer(raw, "<i8", n, n), pa.int64(), mask=np.frombuffer(raw, np.uint8, n) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, _number(name), np.int64)), pa.array(np.arange(n)), docs], names=["file", "ordinal", "doc_id"])

    return _files(spark, f"{path}/kind=docs").mapInArrow(listed, "file long, ordinal long, doc_id long")


def ends_in(ids: np.ndarray, end: int = END) -> np.ndarray:
    return np.flatnonzero(ids == end)


def scan(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """file, ordinal, start, n_tokens (without the end) and finished of every document in the files under path.

    file is the number that a file's name gives, or null; files without one are told apart by their path.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                for k, at in enumerate(range(0, len(ids), block)):
                    found = ends_in(ids[at : at + block], end) + at
                    last = at + block >= len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_number(name)], pa.int64()), pa.array([name]), pa.array([k], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64())), pa.array([int(found[-1]) if len(found) else None], pa.int64()), pa.array([len(ids) if last else None], pa.int64())],
                        names=["file", "path", "block", "ends", "last_end", "size"],
                    )

    found = _files(spark, path).mapInArrow(blocks, "file long, path string, block long, ends array<long>, last_end long, size long")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.withColumns({"carried": F.coalesce(F.max("last_end").over(before), F.lit(-1)), "documents": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long")})
    # places of ends, with that before the block in front and, in a file's last block, its size behind
    places = F.concat(F.array("carried"), "ends")
    rows = scanned.select("file", "documents", places.alias("at"), F.size("ends").alias("n"), "size")
    rows = rows.withColumn("doc", F.explode(F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.struct(i.alias("i"), (F.get("at", i) + 1).alias("start"), F.when(i < F.col("n"), F.get("at", i + 1)).alias("end")))))
    start, stop = F.col("doc.start"), F.coalesce("doc.end", "size")
    out = rows.where(F.col("doc.end").isNotNull() | (F.col("size") > start))
    return out.select("file", (F.col("documents") + F.col("doc.i")).alias("ordinal"), start.alias("start"), (stop - start).alias("n_tokens"), F.col("doc.end").isNotNull().alias("finished"))


def matched(placed: DataFrame, counted: DataFrame) -> DataFrame:
    """Each placed row with its scanned document; the query fails if either has no partner."""
    at = ["file", "ordinal"]
    both = placed.withColumn("placed", F.lit(True)).join(counted.withColumn("scanned", F.lit(True)), at, "full")
    lost = F.raise_error(F.concat(F.lit("a document and its ids don't meet at "), F.to_json(F.struct(*at))))
    whole = F.col("placed").isNotNull() & F.col("scanned").isNotNull()
    return both.withColumn("n_tokens", F.when(whole, F.col("n_tokens")).otherwise(lost.cast("long")))


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", file_bytes: int = FILE_BYTES, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, file and start of every row of docs, from files written (to path, if given) and scanned."""
    spark, path = docs.sparkSession, path or new_path(docs.sparkSession, "tokens")
    write(docs, path, ranks_path, pattern, id_col, file_bytes=file_bytes)
    if all(f.getPath().getName().startswith("_") for f in _listing(spark, path)):
        return spark.createDataFrame([], "doc_id long, n_tokens long, file long, start long")
    return matched(identifiers(spark, path), scan(spark, f"{path}/kind=ids", block=block)).select("doc_id", "n_tokens", "file", "start")


def _listing(spark: SparkSession, path: str) -> list:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return list(p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))
