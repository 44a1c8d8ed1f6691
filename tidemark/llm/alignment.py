"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in a corpus.

The tokens of both sides are the nodes of a bipartite graph whose links join tokens with overlapping byte ranges. A
union-find over all tokens of a batch (roots hooked to smaller ones, paths halved until they are flat) gives its components, which are the
smallest groups of tokens that cover the same bytes on both sides. Each component's members expand to its links.

How many documents hold a pair of ids linked is counted in two steps. A block of documents (BLOCK_BYTES of text) writes a dictionary of
its distinct pairs with the number of its documents that hold each, and its documents as places in that dictionary; so a pair leaves a
block once. Counts are summed by pair, the highest one of each id of the first side is marked, and both come back by
pair to the dictionaries of the blocks, where the documents' links are summed up. No table of pairs is broadcast, and
no group is larger than a block's dictionary or, for an id's highest count, than the other side's vocabulary.

The first tokenizer encodes a space and the text, the second adds its space itself; special tokens' strings are plain text.

Defined results: null and empty texts, and those whose bytes aren't the tokens' bytes (where the second tokenizer
normalises), have no tokens, zeros and an empty digest; a null identifier is kept; repeated rows count as documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .packing import codec
from .shared import in_batches, staged

#: Bytes of text and rows of a block, about.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 100_000

_DOCS = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_pairs array<long>, groups_sha256 array<string>, groups array<string>"
BLOCK = f"block long, {_DOCS}, places binary, times binary, pairs array<long>, holders array<long>"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"

_SIDES: dict = {}


def piece_bytes(piece: str) -> bytes:
    """A piece's bytes: U+2581 stands for a space, <0xHH> for a byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Side:
    """The second tokenizer: ids of a text and the bytes of each id."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes = [piece_bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)


class Pair:
    """Both tokenizers, and how their ids are spelled in a group: followed by another of the side, or by none."""

    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        self.a, self.b = codec(ranks_path, pattern), Side(model_path)
        self.n_a, self.n_b = self.a.n_vocab, len(self.b.bytes)
        self.a_lengths = np.zeros(self.n_a, np.int64)
        for token in self.a.token_byte_values():
            self.a_lengths[self.a.encode_single_token(token)] = len(token)
        self.spelled = [b"%d%s" % (i, end) for n, ends in ((self.n_a, (b",", b"|")), (self.n_b, (b",", b";", b""))) for end in ends for i in range(n)]


def both(ranks_path: str, pattern: str, model_path: str) -> Pair:
    """The tokenizers, once for each worker."""
    key = (ranks_path, pattern, model_path)
    if key not in _SIDES:
        _SIDES[key] = Pair(*key)
    return _SIDES[key]


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of n nodes, for links (u, v)."""
    parent = np.arange(n)
    while len(u):
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            break
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all overlapping tokens, given where each token ends; both sides cover the same bytes.

    Two ranges that overlap do so in one run of bytes without an end inside, and each run between neighbouring ends is in
    one token of either side, so the links are those runs.
    """
    last = int(a_ends[-1]) if len(a_ends) else 0
    marks = np.zeros(last + 1, np.uint8)
    marks[a_ends] = 1
    marks[b_ends] |= 2
    at = np.flatnonzero(marks)
    is_a, is_b = (marks[at] & 1).astype(np.int64), (marks[at] >> 1).astype(np.int64)
    return np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b


def grouped(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group, numbered from the left, of each token of either side."""
    root = union_find(n_a + n_b, a, n_a + b)
    number = np.cumsum(root[:n_a] == np.arange(n_a)) - 1  # a root is the first token of its group on the first side
    return number[root[:n_a]], number[root[n_a:]]


def spelling(pair: Pair, a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in pair.spelled of all tokens, group by group, and how many there are up to each document's end.

    doc_ends: for each document the number of tokens of the second side up to its end.
    """
    n = int(a_group[-1]) + 1 if len(a_group) else 0
    of_a, of_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    ends = np.cumsum(of_a + of_b)
    a_last, b_last = np.append(a_group[1:] != a_group[:-1], True)[: len(a_group)], np.append(b_group[1:] != b_group[:-1], True)[: len(b_group)]
    final = np.zeros(len(b_ids), bool)
    final[doc_ends[doc_ends > 0] - 1] = True
    out = np.empty(len(a_ids) + len(b_ids), np.int64)
    a_at = np.arange(len(a_ids)) + (np.cumsum(of_b) - of_b)[a_group]
    b_at = np.arange(len(b_ids)) + np.cumsum(of_a)[b_group]
    out[a_at] = a_ids + pair.n_a * a_last
    out[b_at] = 2 * pair.n_a + b_ids + pair.n_b * (b_last.astype(np.int64) + final)
    return out, np.where(doc_ends > 0, ends[b_group[np.maximum(doc_ends, 1) - 1]] if len(b_group) else 0, 0)


class _Block:
    """What a block's documents add up to."""

    def __init__(self):
        self.size, self.docs, self.pairs, self.times = 0, [[] for _ in range(8)], [], []

    def row(self, number: int) -> pa.RecordBatch:
        found, place, holders = np.unique(np.concatenate([np.zeros(0, np.int64), *self.pairs]), return_inverse=True, return_counts=True)
        columns = [pa.array([number], pa.int64())]
        for values, kind in zip(self.docs, [pa.int64()] * 6 + [pa.string()] * 2, strict=True):
            columns.append(pa.array([values], pa.list_(kind)))
        times = np.concatenate([np.zeros(0, np.int64), *self.times])
        columns += [pa.array([_planes(x)], pa.binary()) for x in (place, times)]
        columns += [pa.array([x], pa.list_(pa.int64())) for x in (found, holders)]
        names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "groups_sha256", "groups", "places", "times", "pairs", "holders"]
        return pa.RecordBatch.from_arrays(columns, names=names)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as all their first bytes, then all second ones and so on, which compresses well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _fill(block: _Block, pair: Pair, doc_ids: list, texts: pa.Array, with_groups: bool) -> None:
    a_all, b_all, a_n, b_n = [], [], [], []
    for text in texts.to_pylist():
        a = b = ()
        if text:
            b = pair.b.model.encode(text)
            if b"".join(map(pair.b.bytes.__getitem__, b)) == (raw := b" " + text.encode()):
                a = pair.a.encode_to_numpy(f" {text}", disallowed_special=())
                a_all.append(a)
                b_all.append(np.array(b, np.int64))
            else:
                b = ()
            block.size += len(raw)
        a_n.append(len(a))
        b_n.append(len(b))
    none = np.zeros(0, np.int64)
    a_ids, b_ids = np.concatenate([none, *a_all]).astype(np.int64), np.concatenate([none, *b_all])
    a_n, b_n = np.array(a_n, np.int64), np.array(b_n, np.int64)
    a_ends = np.cumsum(a_n)
    a, b = overlaps(np.cumsum(pair.a_lengths[a_ids]), np.cumsum(pair.b.lengths[b_ids]))
    a_group, b_group = grouped(len(a_ids), len(b_ids), a, b)
    spell, ends = spelling(pair, a_ids, b_ids, a_group, b_group, np.where(b_n > 0, np.cumsum(b_n), 0))
    parts = list(map(pair.spelled.__getitem__, spell.tolist()))
    doc = np.repeat(np.arange(len(a_n)), a_n)  # of each token of the first side
    last_group = np.append(-1, a_group)[a_ends]
    n_groups = np.diff(np.append(-1, last_group))
    # the links of a document, each pair of ids once with its number of times
    both_ids = pair.n_a * pair.n_b
    keys, times = np.unique(doc[a] * both_ids + a_ids[a] * pair.n_b + b_ids[b], return_counts=True)
    n_pairs = np.bincount(keys // both_ids, minlength=len(a_n))
    n_links = np.bincount(doc[a], minlength=len(a_n))
    block.pairs.append(keys % both_ids)
    block.times.append(times)
    at = 0
    for d, end in enumerate(ends.tolist()):
        said = b"".join(parts[at:end]) if end else b""
        at = max(at, end)
        block.docs[6].append(hashlib.sha256(said).hexdigest() if end else "")
        block.docs[7].append(said.decode() if with_groups else None)
    for values, more in zip(block.docs, (doc_ids, a_n, b_n, n_groups, n_links, n_pairs), strict=False):
        values.extend(more if isinstance(more, list) else more.tolist())


def blocks(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """BLOCK, staged."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, number = both(ranks_path, pattern, model_path), _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            _fill(block, pair, batch.column(0).to_pylist(), batch.column(1), with_groups)
            if block.size >= BLOCK_BYTES or len(block.docs[0]) >= BLOCK_ROWS:
                yield block.row(number)
                block, number = _Block(), number + 1
        if block.docs[0]:
            yield block.row(number)

    rows = in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(align, BLOCK), "alignment-blocks", "zstd")


def _held(found: DataFrame) -> DataFrame:
    """block, place, pair, holders: the dictionaries as rows."""
    return found.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "of")).select("block", "place", F.col("of.pairs").alias("pair"), F.col("of.holders").alias("holders"))


def counted(found: DataFrame, n_b: int) -> DataFrame:
    """pair, docs, best: documents that hold each pair, and whether no pair of its first id has more."""
    totals = staged(_held(found).groupBy("pair").agg(F.sum("holders").alias("docs")), "alignment-pairs")
    of = F.expr(f"pair div {n_b}")
    highest = totals.groupBy(of.alias("a")).agg(F.max("docs").alias("most"))
    # one row for each id of a vocabulary at most
    return totals.withColumn("a", of).join(F.broadcast(highest), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _sizes(ranks_path: str, pattern: str, model_path: str) -> int:
    return both(ranks_path, pattern, model_path).n_b


def pair_counts(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, docs, best of every pair of ids that is linked somewhere."""
    n_b = _sizes(ranks_path, pattern, model_path)
    totals = counted(blocks(docs, ranks_path, pattern, model_path, id_col, text_col, False), n_b)
    return totals.select(F.expr(f"pair div {n_b}").alias("a"), (F.col("pair") % n_b).alias("b"), "docs", "best")


def aligned(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """OUT for every row of docs; groups, `a1,a2|b1;a3|b2,b3`, only if they are asked for."""
    found = blocks(docs, ranks_path, pattern, model_path, id_col, text_col, with_groups)
    counts = _held(found).select("block", "place", "pair").join(counted(found, _sizes(ranks_path, pattern, model_path)), "pair").select(F.col("block").alias("of_block"), "place", "docs", "best")

    def sums(key: tuple, block: pa.Table, dictionary: pa.Table) -> pa.Table:
        one = block.to_pylist()[0]
        docs, best = np.zeros(dictionary.num_rows, np.int64), np.zeros(dictionary.num_rows, np.int64)
        place = dictionary.column("place").to_numpy()
        docs[place], best[place] = dictionary.column("docs").to_numpy(), dictionary.column("best").to_numpy(zero_copy_only=False)
        places, times, n = _numbers(one["places"]), _numbers(one["times"]), np.array(one["n_pairs"], np.int64)
        starts, out = (np.cumsum(n) - n)[n > 0], []
        for value in (best, docs):
            total = np.zeros(len(n), np.int64)
            if len(starts):
                total[n > 0] = np.add.reduceat(value[places] * times, starts)
            out.append(pa.array(total))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
        columns = [pa.array(one[c], pa.int64()) for c in names[:5]] + out + [pa.array(one[c], pa.string()) for c in names[7:]]
        return pa.Table.from_arrays(columns, names=names)

    rows = found.drop("pairs", "holders").groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(sums, OUT)
    return rows if with_groups else rows.drop("groups")
