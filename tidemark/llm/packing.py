"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention within the piece). Documents are cut into full
pieces, each a sequence of its own, and a rest. The rests of a group are assigned in descending order to the
sequence with the lowest cost so far that still has room; a rest that doesn't fit there whole is cut, and goes on
with the next. So all sequences of a group but the last tokens are full. These last tokens, fewer than the
capacity, become sequences whose lengths are the powers of two of their number: they need no padding.

Groups have a bounded number of tokens and of rows and are dealt from the task and the row within it, so one identifier or
source can't swell a group; their number follows the size of the corpus.

Special tokens' strings in a text become their own ids, as the library's default is; which there are is a parameter.

Defined results: null text is empty; an empty text is one end token; a null identifier is kept; repeated rows are packed separately (their
pieces have equal identifiers); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import in_batches

CAPACITY = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Characters of text behind a group, about; a group's rests are at most so many tokens in one task.
GROUP_CHARS = 12_000_000
#: Characters that a row counts as beside its text's, so that a group of short texts is bounded too.
ROW_CHARS = 100
END = 0

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_MID = "grp long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"

_CODECS: dict = {}


def special_tokens(path: str) -> dict[str, int]:
    """Ids by string of the special tokens in a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def codec(ranks_path: str, pattern: str, special: dict[str, int] | None = None):
    """tiktoken's encoder for a rank file, one for each worker."""
    import tiktoken

    key = (ranks_path, pattern, tuple(sorted((special or {}).items())))
    if key not in _CODECS:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODECS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
    return _CODECS[key]


def encoded(enc, text: str | None) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers; strings of the encoder's special tokens give their ids."""
    return np.asarray(enc.encode_to_numpy(text, allowed_special="all", disallowed_special=()), dtype="<u4") if text else np.zeros(0, "<u4")


def narrow(ids: np.ndarray) -> np.ndarray:
    """ids in 16 bits; an id that doesn't fit is an error."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError(f"id {int(ids.max())} doesn't fit in 16 bits")
    return ids.astype("<u2")


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(piece, start, length, sequence, offset) of the cut pieces; every length is below the capacity."""
    total = sum(lengths)
    full, rest = divmod(total, capacity)
    rooms = [capacity] * full + [1 << k for k in range(capacity.bit_length(), -1, -1) if rest >> k & 1]
    used, out = [0] * len(rooms), []
    heap = [(0.0, s) for s in range(full)]
    tail = full
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[i]
        while left:
            if heap:
                cost, s = heapq.heappop(heap)
            else:
                while used[tail] == rooms[tail]:
                    tail += 1
                cost, s = 0.0, tail
            n = min(left, rooms[s] - used[s])
            out.append((i, start, n, s, used[s]))
            used[s] += n
            start, left = start + n, left - n
            if s < full and used[s] < rooms[s]:
                heapq.heappush(heap, (cost + LINEAR * n + QUADRATIC * n * n, s))
    return out


def packed(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, special: dict[str, int] | None = None) -> DataFrame:
    """A row (OUT) for every piece of every row of docs; special: ids of special tokens' strings."""
    docs = in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chars, rows = docs.agg(F.sum(F.length("text")), F.count("*")).first()
    groups = max(1, -(-((chars or 0) + ROW_CHARS * rows) // GROUP_CHARS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = codec(ranks_path, pattern, special), 7919 * TaskContext.get().partitionId()
        tail = np.array([end], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encoded(enc, text.as_py()), tail])
                n, grp = len(ids), row % groups
                row += 1
                raw = ids.tobytes()
                for at in range(0, n, capacity):
                    piece = raw[4 * at : 4 * (at + capacity)]
                    whole = len(piece) == 4 * capacity
                    # ids below 2**16 travel in two bytes
                    rows.append((grp, doc, at, len(piece) // 4, zlib.crc32(piece) if whole else None, n, None if whole else ids[at:].astype("<u2").tobytes() if ids.max() < 65536 else ids[at:].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.binary()], strict=True)], names=["grp", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "length"], kind="stable")
        whole = pdf["ids"].isna().to_numpy()
        base = int(pdf["grp"].iloc[0]) << 32
        out = pdf.loc[whole, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"], out["offset"] = base + np.arange(len(out)), 0
        rest = list(pdf.loc[~whole, ["doc_id", "start", "length", "doc_tokens", "ids"]].itertuples(index=False))
        rows = []
        for i, start, n, s, offset in pack([r.length for r in rest], capacity):
            r = rest[i]
            ids = np.frombuffer(r.ids, "<u2" if len(r.ids) == 2 * r.length else "<u4")[start : start + n].astype("<u4")
            rows.append((r.doc_id, r.start + start, n, zlib.crc32(ids.tobytes()), r.doc_tokens, base + len(out) + s, offset))
        more = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return pd.concat([out, more], ignore_index=True).astype({c: "Int64" if c == "doc_id" else "int64" for c in more.columns})

    return docs.mapInArrow(cut, _MID).groupBy("grp").applyInPandas(assign, OUT)
