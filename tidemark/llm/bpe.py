"""Byte-level BPE: ranked merges folded over the byte arrays of words by Spark's higher-order functions.

A word is a match of the pattern. The distinct words of the corpus are counted, and the merges of the most
frequent of them, HELD at most, are folded once; what they give is broadcast (its size has that bound). Words
beyond them are folded where they occur, so every word goes through the same fold and nothing is capped or left
out. The rank map is a literal: the merged token's rank by the pair of neighbouring tokens, in small arrays chosen
by the pair modulo BUCKETS, so a look-up takes constant time. The state of the fold is an array in which tokens and the
ranks of their pairs alternate; a word starts as the tokens of its bytes with the ranks of these pairs. A step takes the
lowest rank at its leftmost place, merges that pair and looks up the
ranks on its sides. A rank is the merged token's id; in the array TOKEN is added to tokens, so the least element is a
rank while there is one, and STOP stands at both ends, so each pair has sides.
Words of more than LONG bytes would make the fold's quadratic copying felt; they are merged with a heap instead.

Decoding concatenates the binary pieces of the ids: `decode` is the expression for it; `encode`, which decodes every
document again for its digest, takes the pieces in Arrow, at some tenth of the cost.

Chunks are counted natively; texts are split at the single spaces between characters that aren't white space: no match of PATTERN
spans such a space, but one starts there. Splitting, coding the distinct chunks of a batch and putting their ids in a row are Arrow's;
Python sees each distinct chunk of a batch once. The ids of chunks are kept, up to a bound. With another pattern, of which
this isn't known, whole texts are matched.

Defined results: null text is empty, and has no ids; special tokens' strings are ordinary text; null identifiers are kept;
repeated rows give equal rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .shared import in_batches, most_frequent, staged
from .words import WordTable, hashed

HELD = 2_000_000
LONG = 1_000
BUCKETS = 65_521
TOKEN, STOP = 1 << 20, 1 << 21
#: Fixed value: the pattern of the tokenizers whose chunks are known to end at single spaces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Python's patterns have it, and a space next to it, in Arrow's syntax.
_WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NEAR = f" {_WHITE}|{_WHITE} "
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_FIRST = "\x01"
#: Chunks whose ids a worker keeps in either of two generations.
_KEPT = 120_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<array<bigint>>: at (pair modulo BUCKETS), pair and rank in turn of the pairs there.

    A pair is left * 2 ** 22 + right, of tokens with TOKEN added, which no rank reaches.
    """
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    for word, rank in ranks.items():
        for i in range(1, len(word)):
            left, right = ranks.get(word[:i]), ranks.get(word[i:])
            if left is not None and right is not None:
                pair = (left + TOKEN << 22) + right + TOKEN
                buckets[pair % BUCKETS] += [pair, rank]
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")


def _rank(table: Column, left: Column, right: Column) -> Column:
    pair = F.shiftleft(left, 22) + right
    at = F.get(table, (pair % BUCKETS).cast("int"))
    # a rank stands behind its pair; without one this is null or the first pair there, which is no rank
    return F.get(at, F.array_position(at, pair).cast("int"))


def _bound(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Speller:
    """Words as `fold` takes them: the tokens of the bytes, or the word's own token, between stops, with the ranks of the
    byte pairs between them (STOP where a pair has none)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = [ranks[bytes([b])] + TOKEN for b in range(256)]
        self.of_pair = [ranks.get(bytes([a, b]), STOP) for a in range(256) for b in range(256)]

    def __call__(self, word: bytes) -> list[int]:
        if (own := self.ranks.get(word)) is not None:
            return [STOP, STOP, own + TOKEN, STOP, STOP]
        n = len(word)
        out = [STOP] * (2 * n + 3)
        out[2:-1:2] = map(self.of_byte.__getitem__, word)
        out[3:-3:2] = [self.of_pair[a << 8 | b] for a, b in zip(word, word[1:], strict=False)]
        return out


def fold(word: Column, table: Column) -> Column:
    """array<bigint>: the ids of one spelled word."""

    def step(z: Column, _: Column) -> Column:
        def merge(m: Column) -> Column:
            merged = m + TOKEN

            def at(k: Column) -> Column:
                middle = F.array(_rank(table, F.get(z, k - 4), merged), merged, _rank(table, merged, F.get(z, k + 2)))
                return F.concat(F.slice(z, F.lit(1), k - 3), middle, F.slice(z, k + 3, F.size(word)))

            return F.when(m < TOKEN, _bound(F.array_position(z, m).cast("int"), at)).otherwise(z)

        return _bound(F.array_min(z), merge)

    def tokens(z: Column) -> Column:  # they stand at the even places between the stops
        return F.transform(F.sequence(F.lit(2), F.size(z) - 3, F.lit(2)), lambda i: F.get(z, i) - TOKEN)

    # a step for each byte, one more than there can be merges
    return F.aggregate(F.sequence(F.lit(2), F.size(word) - 3, F.lit(2)), word, step, tokens)


def merged_with_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids by a heap of pairs over a linked list, in n log n steps."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def pair(i: int):
        j = after[i]
        if j < n and (rank := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n):
        pair(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[i] < n:
            before[after[i]] = i
        pair(i)
        if before[i] >= 0:
            pair(before[i])
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def chunk_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Texts in parts that no match of PATTERN spans: a first one, and others that a single space comes before.

    Texts with a space next to white space come last; the first array says where each was.
    """
    near = pc.match_substring_regex(texts, _NEAR)
    odd = np.asarray(near.to_numpy(zero_copy_only=False), bool)
    parts = [_BETWEEN.split(t) for t in texts.filter(near).to_pylist()]
    plain = pc.split_pattern(texts.filter(pc.invert(near)), " ")
    return np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), pa.concat_arrays([plain, pa.array(parts, plain.type)])


def words_in(pattern: str):
    """A function that splits a chunk in words."""
    import regex

    return regex.compile(pattern).findall


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """word, n for every distinct word of 2 to LONG bytes.

    Chunks are counted natively, and each distinct one is split in words once. Beside white space other than single spaces
    this may give other words than the text's; those are folded where they occur. With another pattern than PATTERN whole texts are split.
    """

    def fitting(words: list[str], times: list[int]) -> pa.RecordBatch:
        raw = pa.array([_utf8(w) for w in words], pa.binary())
        size = pc.binary_length(raw)
        return pa.RecordBatch.from_arrays([raw, pa.array(times, pa.int64())], names=["word", "n"]).filter(pc.and_(pc.greater(size, 1), pc.less_equal(size, LONG)))

    def split_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = words_in(pattern)
        for batch in batches:
            found = Counter(w for t in batch.column(0) for w in split(t.as_py() or ""))
            yield fitting(list(found), list(found.values()))

    def split_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = words_in(pattern)
        for batch in batches:
            words: list[str] = []
            times: list[int] = []
            for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # letters, with a point or comma at most, need no pattern
                if chunk.isalpha():
                    words.append(f" {chunk}")
                    times.append(n)
                elif (chunk[-1:] == "." or chunk[-1:] == ",") and chunk[:-1].isalpha():
                    words.append(f" {chunk[:-1]}")
                    times.append(n)
                else:
                    found = split(chunk[1:] if chunk[:1] == _FIRST else f" {chunk}")
                    words += found
                    times += [n] * len(found)
            yield fitting(words, times)

    if pattern != PATTERN:
        return docs.select("text").mapInArrow(split_whole, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # the first chunk of a text has no space before it, so it is marked
    chunks = docs.select(F.explode(F.split(F.concat(F.lit(_FIRST), F.col("text")), " ")).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
    return chunks.mapInArrow(split_up, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Held:
    """Ids of words, as bytes in the order of a table of words, and what a worker keeps of chunks' ids."""

    table: WordTable
    ids_at: np.ndarray
    ids: bytes
    chunks: tuple[dict[str, bytes], dict[str, bytes]]

    def look_up(self, words: list[bytes]) -> list[bytes | None]:
        """Ids as little-endian unsigned integers, or None."""
        if not len(self.table.hashes):
            return [None] * len(words)
        ids, at = self.ids, self.table.look_up(words)
        ends = zip(at.tolist(), self.ids_at[at].tolist(), self.ids_at[at + 1].tolist(), strict=True)
        return [ids[a:b] if i >= 0 else None for i, a, b in ends]


def id_kind(ranks: dict[bytes, int]) -> str:
    """The type in which ids travel; its highest value stands for a word that is folded in place."""
    return "<u2" if max(ranks.values()) < 0xFFFF else "<u4"


def held_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str, held: int = HELD) -> Held:
    """Ids of the most frequent words."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(ranks)
        for batch in batches:
            start = [speller(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start, pa.list_(pa.int64()))], names=[*batch.schema.names, "start"])

    top = hashed(most_frequent(staged(word_counts(docs, pattern), "bpe-words"), held).select("word"), "word binary")
    started = top.mapInArrow(spell, "word binary, hash long, start array<bigint>")
    folded = started.select("word", "hash", _bound(rank_literal(ranks), lambda t: fold(F.col("start"), t)).cast("array<int>").alias("ids"))
    rows = staged(folded, "bpe-held").toArrow().combine_chunks()
    table, order = WordTable.of(rows["word"].combine_chunks(), rows["hash"].to_numpy().copy())
    ids = rows["ids"].combine_chunks()
    del rows
    kind = id_kind(ranks)
    lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    starts = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype(kind) if len(ids) else np.zeros(0, kind)
    ends = np.cumsum(lengths)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
    return Held(table, (np.concatenate([[0], ends]) * np.dtype(kind).itemsize).astype(np.int32), flat[places].tobytes(), ({}, {}))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", held: int = HELD, with_ids: bool = True) -> DataFrame:
    """SCHEMA, and ids (array<int>) if asked for, of every row of docs."""
    spark, ranks = docs.sparkSession, read_ranks(ranks_path)
    docs = in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = spark.sparkContext.broadcast(held_ids(docs, ranks, pattern, held))
    tokens = spark.sparkContext.broadcast(ranks)
    kind = id_kind(ranks)
    hole_id, chunked = np.iinfo(kind).max, pattern == PATTERN

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words, ranks = words_in(pattern), known.value, tokens.value
        hole, spell = np.array([hole_id], kind).tobytes(), Speller(tokens.value)
        single = {w: np.array([i], kind).tobytes() for w, i in ranks.items() if len(w) == 1}
        young, old = words.chunks  # ids of chunks after a single space
        gc.disable()  # nothing here refers back, and there are many small objects

        def other(w: bytes) -> bytes:
            return single[w] if len(w) == 1 else np.array(merged_with_heap(w, ranks), kind).tobytes()

        def learn(new: list[str], space: str, into: dict[str, bytes]) -> dict[str, list[list[int]]]:
            """Puts the ids of new chunks into `into`; gives the spelled words in them that aren't held."""
            rare: dict[str, list[list[int]]] = {}
            # letters, with a point or comma at most, need no pattern
            alone = [c for c in new if c.isalpha()] if chunked else []
            raw = [(space + c).encode() for c in alone]
            got = words.look_up(raw)
            into.update(zip(alone, got, strict=True))
            for i in [i for i, ids in enumerate(got) if ids is None]:
                if 1 < len(raw[i]) <= LONG:
                    into[alone[i]], rare[alone[i]] = hole, [spell(raw[i])]
                else:
                    into[alone[i]] = other(raw[i])
            rest = set(new).difference(alone)
            for end in ".," if chunked else "":
                ended = [c for c in rest if c[-1:] == end and c[:-1].isalpha()]
                rest.difference_update(ended)
                raw, tail = [(space + c[:-1]).encode() for c in ended], single[end.encode()]
                for c, w, ids in zip(ended, raw, words.look_up(raw), strict=True):
                    if ids is not None:
                        into[c] = ids + tail
                    elif 1 < len(w) <= LONG:
                        into[c], rare[c] = hole + tail, [spell(w)]
                    else:
                        into[c] = other(w) + tail
            parts = {c: [_utf8(w) for w in split(space + c)] for c in rest}
            asked = list({w for p in parts.values() for w in p})
            known, missing = dict(zip(asked, words.look_up(asked), strict=True)), set()
            for w in [w for w, ids in known.items() if ids is None]:
                if 1 < len(w) <= LONG:
                    known[w] = hole
                    missing.add(w)
                else:
                    known[w] = other(w)
            for c, p in parts.items():
                into[c] = b"".join([known[w] for w in p])
                if missing and not missing.isdisjoint(p):
                    rare[c] = [spell(w) for w in p if w in missing]
            return rare

        for batch in batches:
            texts = batch.column(1).fill_null("")
            order, lists = chunk_lists(texts) if chunked else (np.arange(len(texts)), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts))
            flat, starts = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            coded, first = flat.dictionary_encode(), starts[:-1]
            at, behind = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.ones(len(flat), bool)
            behind[first] = False
            used = np.zeros(len(coded.dictionary), bool)
            used[at[behind]] = True  # a first chunk has no space before it, and is looked up for itself
            chunks = coded.dictionary.filter(pa.array(used)).to_pylist()
            new = set(chunks).difference(young)
            if old:
                for c in new & old.keys():
                    young[c] = old[c]
                new.difference_update(young)
            firsts = flat.take(pa.array(first)).to_pylist()
            distinct = {c: len(chunks) + i for i, c in enumerate(dict.fromkeys(firsts))}
            heads: dict[str, bytes] = {}
            rare, rare_heads = learn(list(new), " ", young), learn(list(distinct), "", heads)
            place = np.cumsum(used) - 1
            at = place[at]
            at[first] = [distinct[c] for c in firsts]
            # the ids of all chunks in a row, and where those of each text end
            row = pa.array([*map(young.__getitem__, chunks), *map(heads.__getitem__, distinct)], pa.large_binary()).take(pa.array(at))
            ends = np.frombuffer(row.buffers()[1], np.int64)[row.offset : row.offset + len(at) + 1][starts] if len(at) else np.zeros(1, np.int64)
            ids = pa.Array.from_buffers(pa.binary(), len(order), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), row.buffers()[2] or pa.py_buffer(b"")])
            left: list[list[list[int]]] = [[] for _ in order]
            holes = {i: rare[c] for i, c in enumerate(chunks) if c in rare} if rare else {}
            holes.update((distinct[c], spelled) for c, spelled in rare_heads.items())
            if holes:
                marked = np.zeros(len(chunks) + len(distinct), bool)
                marked[list(holes)] = True
                spots = np.flatnonzero(marked[at])
                for text, i in zip((np.searchsorted(starts, spots, "right") - 1).tolist(), at[spots].tolist(), strict=True):
                    left[text] += holes[i]
            for c in rare:  # they seldom come again
                del young[c]
            if len(young) > _KEPT:
                young, old = {}, young
                words.chunks = young, old
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order)), ids, pa.array(left, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "ids", "rare"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = [b""] * (max(tokens.value.values()) + 1)
        for word, rank in tokens.value.items():
            by_rank[rank] = word
        pieces, size = pa.array(by_rank, pa.large_binary()), np.dtype(kind).itemsize
        for batch in batches:
            at = np.cumsum([0, *(len(x.as_buffer()) // size for x in batch.column(1))])
            ids = np.frombuffer(b"".join([x.as_buffer() for x in batch.column(1)]), kind)
            holes = np.flatnonzero(ids == hole_id)
            if len(holes):
                words = pc.list_flatten(batch.column(2))  # the lists of all rows, in the order of the holes
                repeat = np.ones(len(ids), np.int64)
                repeat[holes] = words.value_lengths().to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(repeat)])[at]
                gone = np.repeat(ids == hole_id, repeat)
                ids = np.repeat(ids, repeat).astype("<u4")
                ids[gone] = words.flatten().to_numpy(zero_copy_only=False)
            ids = ids.astype("<u4")
            # decoding: the pieces of the ids, one behind the other
            taken = pieces.take(pa.array(ids))
            ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
            raw, flat = memoryview(taken.buffers()[2] or b""), memoryview(ids.tobytes())
            digests = [hashlib.sha256(flat[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            places = ends[at].tolist()
            decoded = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(places[:-1], places[1:], strict=True)]
            out = [batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    looked = docs.mapInArrow(look_up, "doc_id long, ids binary, rare array<array<bigint>>")
    folded = looked.select("doc_id", "ids", _bound(rank_literal(ranks), lambda t: F.transform("rare", lambda w: fold(w, t))).alias("rare"))
    return folded.mapInArrow(fill, SCHEMA + (", ids array<int>" if with_ids else ""))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces, from a literal array, concatenated."""
    pieces = [""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        pieces[rank] = word.hex()
    table = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    return F.unhex(F.array_join(_bound(table, lambda t: F.transform(ids, lambda i: F.get(t, i))), ""))
