"""Training order: every sequence gets a global slot by a keyed permutation, and shards are written in slot order.

The ids of documents, each followed by the end id, are one stream for each task, cut into sequences of LENGTH ids;
the last one is filled up with end ids. Sequences are numbered 0 to N - 1 by the tasks' counts. A balanced Feistel
network of ROUNDS keyed rounds permutes the least power of four that is at least N; a result of N or more is put
through it again (cycle-walking) until it is below N, which keeps it a permutation of 0 to N - 1.

Slots are dealt over range partitions of GROUP_SHARDS shards or more, PARTITIONS at most, and written as shards of SHARD slots, one file each, whose records have a
fixed stride: LENGTH ids and one end id, as little-endian unsigned 16-bit integers. So slot s is in shard s // SHARD
at byte (s % SHARD) * stride, and reading can go on at any slot without an index: the shard is a partition column of the
files, so those before the slot's aren't opened. A stretch of known length is read from paths made of its slots, so that
no shard but its own is even listed.

For staging and the shuffle the ids of a sequence are renumbered by frequency, so that their high bytes are mostly
zero, and compressed. The renumbering comes from a few texts; as any permutation of the ids is undone exactly, it only
bears on size.

Defined results: null text is empty; an empty text is an end id; null identifiers are kept; repeated rows are documents of
their own; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .packing import codec, encoded, narrow
from .shared import exists, in_batches, new_path, small, staged
from .token_files import END, separator

LENGTH = 1024
SHARD = 8_192
ROUNDS = 6
#: Range partitions that write the shards, at most, and the shards of each, at least.
PARTITIONS, GROUP_SHARDS = 20_000, 4
#: Texts, and characters of each, from which the renumbering is made.
PEEK, PEEK_CHARS = 400, 20_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def round_keys(key: str) -> np.ndarray:
    import hashlib

    return np.array([int.from_bytes(hashlib.sha256(f"{key}/{i}".encode()).digest()[:8], "little") for i in range(ROUNDS)], np.uint64)


def permuted(numbers: np.ndarray, n: int, key: str) -> np.ndarray:
    """The slots of numbers, all in 0 to n - 1."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask, keys = (np.uint64(1) << half) - np.uint64(1), round_keys(key)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            h = (right + k) * _M1
            h = (h ^ (h >> np.uint64(29))) * _M2
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return (left << half) | right

    out = network(numbers.astype(np.uint64))
    while (over := np.flatnonzero(out >= np.uint64(n))).size:
        out[over] = network(out[over])
    return out.astype(np.int64)


def renumbering(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> np.ndarray:
    """For each number of 16 bits its place by frequency, the end id first."""
    texts = docs.select(F.substring(F.col(text_col).cast("string"), 1, PEEK_CHARS).alias("t")).limit(PEEK).toArrow()["t"].to_pylist()
    enc = codec(ranks_path, pattern)
    counts = np.bincount(np.concatenate([np.zeros(0, "<u4"), *[encoded(enc, t) for t in texts]]).astype(np.int64), minlength=1 << 16)
    counts[END] = counts.max() + 1
    place = np.empty(1 << 16, np.uint16)
    place[np.argsort(-counts, kind="stable")] = np.arange(1 << 16, dtype=np.uint32).astype(np.uint16)
    return place


_SEQUENCES = "part long, no long, first_doc_id long, first_start long, doc_ids array<long>, ids_crc32 long, packed binary"


def sequences(docs: DataFrame, ranks_path: str, pattern: str, place: np.ndarray, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The numbered sequences of each task; packed has their ids, renumbered and compressed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, no = codec(ranks_path, pattern), TaskContext.get().partitionId(), 0
        squeeze, end = zstandard.ZstdCompressor(level=3), np.array([END], "<u2")
        rest, spans, rows = np.zeros(0, "<u2"), [], []  # ids left over; (doc, place of its first id in them)

        def take(n: int) -> None:
            nonlocal rest, spans, no
            ids, rest = rest[:n], rest[n:]
            if len(ids) < length:
                ids = np.concatenate([ids, np.full(length - len(ids), END, "<u2")])
            here = [(d, at) for d, at in spans if at < n]
            spans = [(d, at - n) for d, at in spans[len(here) - 1 :]] if here else spans
            if len(spans) > 1 and spans[1][1] <= 0 or not len(rest):  # the first one ended here
                spans = spans[1:]
            raw = ids.tobytes()
            planes = place[ids].view(np.uint8).reshape(-1, 2).T.tobytes()  # low bytes, then high bytes
            rows.append((part, no, here[0][0], -here[0][1], [d for d, _ in here], zlib.crc32(raw), squeeze.compress(planes)))
            no += 1

        def batch_of() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names=[f.split()[0] for f in _SEQUENCES.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans.append((doc, len(rest)))
                rest = np.concatenate([rest, narrow(encoded(enc, text.as_py())), end])
                while len(rest) >= length:
                    take(length)
            yield batch_of()
        if len(rest):
            take(len(rest))
        yield batch_of()

    return in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, _SEQUENCES)


def with_slots(seqs: DataFrame, key: str, shard: int = SHARD) -> DataFrame:
    """seqs (staged) with number, slot and shard."""
    spark = seqs.sparkSession
    sizes = seqs.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each task
    total, starts = 0, []
    for r in sizes:
        starts.append((r.part, total))
        total += r.n

    @F.arrow_udf(T.LongType())
    def slot(numbers: pa.Array) -> pa.Array:
        return pa.array(permuted(numbers.to_numpy(zero_copy_only=False), total, key))

    first = small(spark.createDataFrame(starts, "part long, first long"))
    return seqs.join(first, "part").withColumn("number", F.col("first") + F.col("no")).drop("first").withColumn("slot", slot("number")).withColumn("shard", F.floor(F.col("slot") / shard).cast("long"))


def write_shards(slotted: DataFrame, path: str, place: np.ndarray) -> None:
    """One file of fixed-stride records in slot order for each shard, in `path/shard=<number>/`."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, ids = zstandard.ZstdDecompressor(), np.argsort(place, kind="stable").astype("<u2")
        for batch in batches:
            raw = [ids[np.ascontiguousarray(np.frombuffer(stretch.decompress(p.as_buffer()), np.uint8).reshape(2, -1).T).view("<u2").ravel()].tobytes() for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["shard", "slot", "ids"])

    last = slotted.agg(F.max("shard")).first()[0]
    if last is None:
        return
    parts = max(1, min(PARTITIONS, -(-(last + 1) // GROUP_SHARDS)))
    ranged = slotted.select("shard", "slot", "packed").repartitionByRange(parts, "shard").mapInArrow(unpacked, "shard long, slot long, ids binary")
    ordered = ranged.sortWithinPartitions("shard", "slot").select("shard", F.col("ids").cast("string").alias("value"))
    ordered.write.options(**separator()).partitionBy("shard").text(path)


def read_from(spark: SparkSession, path: str, slot: int = 0, length: int = LENGTH, shard: int = SHARD, count: int | None = None) -> DataFrame:
    """slot, ids of the records from a slot on, `count` of them if given; slots past the last one give no rows.

    Files of other shards are pruned, those at the ends of the stretch are cut. With a count the shards' paths come from the
    slots; without one the shards are listed.
    """
    stride = 2 * (length + 1)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                stop = None if count is None else max(0, slot + count - number * shard)
                ids = raw.reshape(-1, stride)[max(0, slot - number * shard) : stop, :-2].copy().view("<u2").astype(np.int32)
                at = number * shard + max(0, slot - number * shard) + np.arange(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * length), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(at), lists], names=["slot", "ids"])

    reader = spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
    if count is None:
        files = reader.load(path)  # finds the partition column shard
    else:
        paths = [p for k in range(slot // shard, -(-(slot + count) // shard)) if exists(spark, p := f"{path}/shard={k}")]
        if not paths:
            return spark.createDataFrame([], "slot long, ids array<int>")
        files = reader.option("basePath", path).load(paths)
    return files.select(F.col("shard").cast("long").alias("shard"), "content").where(F.col("shard") >= slot // shard).mapInArrow(records, "slot long, ids array<int>")


def training_order(docs: DataFrame, ranks_path: str, pattern: str, key: str = "epoch-0", path: str | None = None, id_col: str = "doc_id", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """slot, shard, byte_offset, ids_crc32, first_doc_id, first_start and doc_ids of every sequence, its shards written.

    first_start is how many of the first document's ids earlier sequences hold.
    """
    spark, place = docs.sparkSession, renumbering(docs, ranks_path, pattern)
    slotted = with_slots(staged(sequences(docs, ranks_path, pattern, place, id_col, length=length), "order-sequences"), key, shard)
    write_shards(slotted, path or new_path(spark, "order-shards"), place)
    stride = 2 * (length + 1)
    return slotted.select("slot", "shard", (F.col("slot") % shard * stride).alias("byte_offset"), "ids_crc32", "first_doc_id", "first_start", "doc_ids")
