"""Importance resampling towards a target's distribution, over hashed runs of words.

Words are runs of letters beyond ASCII, a-z (A-Z are lowered) and digits; the features of a text are all its runs of
one to three words, each hashed (CRC-32 of its bytes) into one of BUCKETS buckets. Documents are turned into packed
16-bit bucket streams once, written as one binary column, whose offsets are the documents' offsets. The streams are
counted by an external sort: each block is sorted and run-length encoded, runs of a task are added up, and the shuffle
adds up those of all tasks, so that at most BUCKETS rows leave a task. A bucket's gain is the logarithm of how much more frequent
it is in the target; a second pass over the streams gathers the gains and sums them for each document by offsets. A document's score is its weight
plus Gumbel noise from its identifier, and the documents with the highest scores are drawn: a sample without
replacement, in proportion to the weights' exponentials. Ranks are global row numbers over sorted ranges.

A run's hash is combined from those of its words by shifting CRCs (they are linear), so no run is ever spelled.

Defined results: null, empty and wordless texts have no features, weight 0 and a score; a null identifier is hashed as
an empty one and comes last among ties; repeated rows count and are drawn separately; an empty table gives an empty
result, and an empty target gains from smoothing alone; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.numbering import numbered
from .shared import in_batches, staged

BUCKETS = 10_000
ORDERS = 3
#: Documents of fewer words aren't drawn.
LEAST_WORDS = 20
#: Bytes of a word that are hashed for all words of a batch at once; longer words are hashed one by one.
STEPS = 48

STREAM = "doc_id long, n_words long, buckets binary"

_BYTES = np.arange(256, dtype=np.uint8)
#: Each byte as part of a word, lowered, or 0.
_WORD = np.where((_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)), _BYTES, np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES | 0x20, 0)).astype(np.uint8)
_FULL = np.uint32(0xFFFFFFFF)


def _register(byte: int) -> int:
    """The CRC register after one byte from zero: the table that all else follows from."""
    for _ in range(8):
        byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
    return byte


_TABLE = np.array([_register(b) for b in range(256)], np.uint32)


def _shifted(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc through four tables, one for each of its bytes."""
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _shift_tables(lengths: int = 64) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that append 0 to lengths - 1 zero bytes to a CRC, and those for lengths, 2 * lengths, 4 * lengths ... bytes."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    few = [now]
    for _ in range(lengths):
        few.append(now := _TABLE[now & 255] ^ (now >> 8))
    many = [few.pop()]
    while len(many) < 25:
        many.append(_shifted(many[-1], many[-1]))
    return np.stack(few).reshape(-1), many


_FEW, _MANY = _shift_tables()


def appended(crc: np.ndarray, more: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row from theirs and the second one's length."""
    at = (lengths & 63) << 10
    out = _FEW[at + (crc & 255)] ^ _FEW[at + 256 + ((crc >> 8) & 255)] ^ _FEW[at + 512 + ((crc >> 16) & 255)] ^ _FEW[at + 768 + (crc >> 24)]
    long = np.flatnonzero(lengths > 63)
    for k in range(int(lengths.max(initial=0)).bit_length() - 6 if len(long) else 0):
        now = long[(lengths[long] >> (6 + k)) & 1 == 1]
        out[now] = _shifted(_MANY[k], out[now])
    return out ^ more


def with_space(crc: np.ndarray) -> np.ndarray:
    """CRC-32 of a string and a space."""
    crc = crc ^ _FULL
    return _TABLE[(crc ^ 0x20) & 255] ^ (crc >> 8) ^ _FULL


def word_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:start + length] for each word, byte by byte for all words that are still going on."""
    order = np.argsort(np.uint8(STEPS + 1) - np.minimum(length, STEPS + 1).astype(np.uint8), kind="stable")
    at, crc = start[order], np.full(len(order), _FULL)
    going = len(order) - np.cumsum(np.bincount(np.minimum(length, STEPS + 1), minlength=STEPS + 2))  # words longer than k
    for k in range(STEPS):
        n = int(going[k])
        if not n:
            break
        now = crc[:n]
        crc[:n] = _TABLE[(now ^ data[at[:n] + k]) & 255] ^ (now >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ _FULL
    for i in order[: int(going[STEPS])]:
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]])
    return out


def bucket_streams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the buckets of all features by text, and each text's offset among them.

    data: UTF-8 of the texts in a row; offsets: where each starts, and the end. The features that end at a word stand together.
    """
    texts = len(offsets) - 1
    data = _WORD[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # a text's first byte goes on with no word of the text before
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[1:-1][heads]
    tails = heads[heads > 0] - 1
    last[tails] = inside[1:-1][tails]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    words_before = np.searchsorted(start, offsets)
    words = np.diff(words_before)
    place = np.arange(len(start)) - np.repeat(words_before[:-1], words)
    one = word_crcs(data, start, length)
    spaced = with_space(one)
    two, three = np.zeros_like(one), np.zeros_like(one)
    two[1:] = appended(spaced[:-1], one[1:], length[1:])
    three[2:] = appended(with_space(two[1:-1]), one[2:], length[2:])
    ends = np.cumsum(np.minimum(place + 1, ORDERS))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint16)
    at = ends - np.minimum(place + 1, ORDERS)
    out[at] = one % np.uint32(buckets)
    for k, crc in ((1, two), (2, three)):
        has = place >= k
        out[at[has] + k] = crc[has] % np.uint32(buckets)
    return words, out, np.append(0, ends)[words_before]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of an Arrow column in a row, and offsets, from 0."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def streams(docs: DataFrame, id_col: str | None, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """STREAM, staged: for each row its bucket stream as little-endian unsigned 16-bit integers."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError(f"{buckets} buckets don't fit in 16 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, out, at = bucket_streams(*text_bytes(batch.column(1)), buckets)
            packed = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer((2 * at).astype(np.int64)), pa.py_buffer(out.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), packed.cast(pa.binary())], names=["doc_id", "n_words", "buckets"])

    key = F.lit(None) if id_col is None else F.col(id_col)
    rows = in_batches(docs).select(key.cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(pack, STREAM), "bucket-streams", "zstd")


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a batch's streams in a row, and the offset of each."""
    data, offsets = text_bytes(column)
    return np.frombuffer(data.tobytes(), "<u2"), offsets // 2


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: blocks sorted and run-length encoded, runs added up in each task and then over all."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            block = np.sort(_stream(batch.column(0))[0], kind="stable")
            if len(block):
                heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                total[block[heads]] += np.diff(np.append(heads, len(block)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    return packed.select("buckets").mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the source, rounded down."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s_all + buckets) / ((source.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)], np.int64)


def weighted(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each stream: the gains gathered, and summed by offsets."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, at = _stream(batch.column(2))
            n = np.diff(at)
            weight = np.zeros(len(n), np.int64)
            if len(block):  # an empty stream isn't a range, so only the others' offsets are given
                weight[n > 0] = np.add.reduceat(gain[block], at[:-1][n > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = 42, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of docs; of those with at least
    `least_words` words, `percent` in a hundred are drawn."""
    packed = streams(docs, id_col, text_col, buckets)
    counts = [{r.bucket: r.n for r in bucket_counts(p, buckets).collect()} for p in (packed, streams(target, None, target_col, buckets))]
    rows = weighted(packed, gains(*counts, buckets))
    noise = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    rows = staged(rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(noise)))), "resampled")
    long_enough = F.col("n_words") >= least_words
    drawn = percent * rows.where(long_enough).count() // 100
    placed = numbered(rows.where(long_enough), [F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    out = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place").unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
