"""Tables of words that are broadcast: flat arrays, looked up by hash and confirmed by bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

_ODD = np.uint64(0x9E3779B97F4A7C15)


class HashIndex:
    """Places of distinct non-negative 64-bit keys, by open addressing with vectorised probes."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several keys for a slot the last one stays
            mine = self.keys[slot] == keys[left]
            self.at[slot[mine]] = left[mine]
            left, slot = left[~mine], (slot[~mine] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """For each key its place in the keys given, or -1."""
        slot = self._slots(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.at[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            seen = self.keys[slot]
            hit = seen == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            go = ~hit & (seen >= 0)
            left, slot = left[go], slot[go]
        return out


def hash_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hashed(words: DataFrame, schema: str) -> DataFrame:
    """words (its first column, word, in bytes) with hash behind; schema is that of words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hash_of(batch.column(0).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h)], names=[*batch.schema.names, "hash"])

    return words.mapInArrow(add, f"{schema}, hash long")


@dataclass
class WordTable:
    """Words in order of their hashes, their bytes in a row; a hash only proposes a place, the bytes decide."""

    hashes: np.ndarray
    data: bytes
    offsets: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, hashes: np.ndarray) -> tuple[WordTable, np.ndarray]:
        """The table, and the order in which it holds the words."""
        order = np.argsort(hashes.view(np.uint64), kind="stable")
        words = words.cast(pa.large_binary()).take(pa.array(order))
        words = pa.concat_arrays([words])  # from offset 0
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)
        offsets, data = offsets.astype(np.uint32 if offsets[-1] < 1 << 32 else np.int64), words.buffers()[2]
        return cls(hashes.view(np.uint64)[order], data.to_pybytes()[: offsets[-1]] if data is not None else b"", offsets), order

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """For each word its place in the table, or -1."""
        n = len(self.hashes)
        if not n or not words:
            return np.full(len(words), -1, np.int64)
        h = hash_of(words)
        at = np.searchsorted(self.hashes, h)
        at[at == n] = 0
        out = np.full(len(words), -1, np.int64)
        near, data, offsets = np.flatnonzero(self.hashes[at] == h), self.data, self.offsets
        at = at[near]
        for k, i, a, b in zip(near.tolist(), at.tolist(), offsets[at].tolist(), offsets[at + 1].tolist(), strict=True):
            if data[a:b] == words[k]:
                out[k] = i
                continue
            while (i := i + 1) < n and self.hashes[i] == h[k]:  # another word with the same hash
                if data[int(offsets[i]) : int(offsets[i + 1])] == words[k]:
                    out[k] = i
                    break
        return out
