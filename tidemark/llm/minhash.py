"""Near duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

A document's set holds 64-bit hashes of its shingles of WIDTH words (a parameter). One hash function deals the set into BINS bins by
its leading bits, and a bin's value is its smallest hash; an empty bin takes the value of the first non-empty bin
in its own fixed random order of bins (optimal densification). Bands of ROWS bins give BANDS bucket keys. Documents
with the same words in the same order are one node. Within a bucket every node is linked with the smallest node
only (a star), so a bucket of m nodes gives m - 1 candidates. Candidates are confirmed on the full sets.

A star can miss a link between two nodes neither of which is similar to the centre. So the buckets whose nodes are
still in different components are gone through again, in blocks of bounded size: node pairs of different components
are confirmed too if at least two bands agree, the share of agreeing bins is not too far below the similarity
(DEVIATIONS standard deviations of it at 0.8, for as many bins as the smaller set can fill), and the intersection of
their sets, folded to 16 or 32 bits a shingle, doesn't rule the link out (folding can only raise that bound). A pair
is looked at in the bucket of its first common band only. Pairs within one component can't change the components. At similarity 0.8 a band agrees with probability 0.262, so no band of 40
agrees with probability 5e-6, and fewer than two with 8e-5; there are no caps.

Defined results: null, empty and blank texts have no shingles, and are their own components; a text of fewer words
than a shingle's has one shingle of all of them; repeated rows and equal texts share a component; a null identifier is never the smallest one
(component_id is null if all are); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .graph import connected_components
from .shared import from_files, in_batches, small, staged, without

ROWS, BANDS = 6, 40
BINS = ROWS * BANDS
SIMILARITY_PERCENT = 80
#: Words of a shingle.
WIDTH = 5
#: Nodes of a bucket that are compared at once.
BLOCK = 1_500
DEVIATIONS = 4.7
#: Sets up to this size are folded to 16 bits a shingle, larger ones to 32.
FOLD_LIMIT = 2_000

_RNG = np.random.default_rng(20_240_817)
#: The order in which an empty bin tries the others.
_ORDERS = np.argsort(_RNG.random((BINS, BINS)), axis=1).astype(np.int16)
_ODD = _RNG.integers(1, 1 << 63, BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STARTS = ((np.arange(BINS, dtype=object) << 64) // BINS).astype(np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(31)

SCHEMA = "doc_id long, locator struct<file: string, row: long>, node binary, n_shingles long, bands array<long>, sig binary, shingles array<long>"


class _Hashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingle_set(words: list[bytes], hashes: dict, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles of `width` words; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = h[: len(h) - width + 1] if width > 1 else mixed(h)
    for k in range(1, width):
        out = mixed(out * _M1 + mixed(h[k : len(h) - width + 1 + k] + _M2))
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified values of the bins of a non-empty ascending set."""
    at = np.searchsorted(shingles, _STARTS)
    full = np.append(at[1:], len(shingles)) > at
    out = np.zeros(BINS, np.uint64)
    out[full] = shingles[at[full]]
    if not full.all():
        empty = np.flatnonzero(~full)
        first = full[_ORDERS[empty]].argmax(axis=1)
        out[empty] = out[_ORDERS[empty, first]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band; it holds the band's number, so keys of different bands don't meet."""
    parts = mixed(sig * _ODD).reshape(BANDS, ROWS)
    return mixed(parts.sum(axis=1, dtype=np.uint64) + mixed(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes, seen = _Hashes(), set()
    for batch in batches:
        ids, texts, locators = batch.columns
        nodes, counts, bands, sigs, sets = [], [], [], [], []
        for text in texts:
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            if not words:
                nodes.append(None), counts.append(0), bands.append(None), sigs.append(None), sets.append(None)
                continue
            node = xxhash.xxh3_128_digest(b" ".join(words))
            s = shingle_set(words, hashes, width)
            nodes.append(node), counts.append(len(s))
            if node in seen:  # equal texts of a task carry their set once
                bands.append(None), sigs.append(None), sets.append(None)
            else:
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(node)
                sig = signature(s)
                bands.append(band_keys(sig))
                sigs.append((sig >> _S).astype(np.uint8).tobytes())
                sets.append(s.view(np.int64))
        yield pa.RecordBatch.from_arrays([ids, locators, pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), _lists(bands), pa.array(sigs, pa.binary()), _lists(sets)], names=["doc_id", "locator", "node", "n_shingles", "bands", "sig", "shingles"])


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)]).astype(np.int32)
    values = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([r is None for r in rows], pa.bool_())) if rows else pa.array([], pa.list_(pa.int64()))


def held_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, shingles of the nodes in pairs, one row for each: sets has a node's set once for each task that met it, and a
    pair would be joined for each two of these."""
    ends = staged(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-ends")
    return sets.join(small(ends), "node").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; sets has node, shingles."""
    held = held_sets(pairs, sets)
    a, b = (held.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b").distinct()


@F.arrow_udf(T.BinaryType())
def _folded(sets: pa.Array) -> pa.Array:
    """Ascending distinct low bits of the shingles: 16 bits, for sets of over FOLD_LIMIT 32."""
    out = []
    for s in sets:
        x = s.values.to_numpy().view(np.uint64) >> np.uint64(8)
        out.append(np.unique(x.astype(np.uint16 if len(x) <= FOLD_LIMIT else np.uint32)).tobytes())
    return pa.array(out, pa.binary())


def _unfold(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if n <= FOLD_LIMIT else np.uint32)


def _may_link(a: bytes, others: list[bytes], n: int, ns: np.ndarray) -> np.ndarray:
    """Whether the folded sets leave the links of one node with others possible; n, ns: the sizes of the full sets.

    Of y's shingles at most those at places that x has too are common, and those that y lost by folding.
    """
    x, out = _unfold(a, n), np.empty(len(others), bool)
    marks = np.zeros(1 << 16, bool)
    marks[x.astype(np.uint16)] = True
    for k, raw in enumerate(others):
        size = int(ns[k])
        y = _unfold(raw, size)
        if x.dtype == y.dtype == np.uint32:
            common = len(np.intersect1d(x, y, assume_unique=True))
        else:
            common = int(marks[y.astype(np.uint16)].sum())
        common = min(n, common + size - len(y))
        out[k] = 100 * common >= SIMILARITY_PERCENT * (n + size - common)
    return out


def _across(pdf):
    """Pairs of a block whose components differ and whose signatures and folded sets are near enough."""
    import pandas as pd

    bands = np.vstack(pdf["bands"].to_numpy())
    here = (bands[0] == pdf["key"].iloc[0]).argmax()  # the bucket's band
    before, bands = bands[:, :here], bands.astype(np.uint16)  # the low bits count agreements, where chance only costs time
    comp, node, size, folded = pd.factorize(pdf["comp"])[0], pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["folded"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
    left, right = (np.flatnonzero(pdf[c].to_numpy()) for c in ("is_left", "is_right"))
    found = set()
    for start in range(0, len(left), 256):
        i = left[start : start + 256]
        same, earlier = np.zeros((len(i), len(right)), np.uint8), None
        for k in range(bands.shape[1]):
            if k == here:
                earlier = same > 0
            same += bands[i, k][:, None] == bands[right, k][None, :]
        x, y = np.nonzero((same >= 2) & (comp[i][:, None] != comp[right][None, :]))
        doubt = earlier[x, y]  # a pair is left to an earlier bucket only if whole keys agree there
        x, y = i[x], right[y]
        for at in range(0, len(x), 100_000):
            p, q = x[at : at + 100_000], y[at : at + 100_000]
            ok = ~doubt[at : at + 100_000]
            ok[~ok] = ~(before[p[~ok]] == before[q[~ok]]).any(axis=1)
            p, q = p[ok], q[ok]
            small, large = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
            least = SIMILARITY_PERCENT / 100 - DEVIATIONS * np.sqrt(0.16 / np.minimum(small, BINS))
            ok = ((sig[p] == sig[q]).mean(axis=1) >= least) & (100 * small >= SIMILARITY_PERCENT * large)
            p, q = p[ok], q[ok]
            for a in np.unique(p):
                qs = q[p == a]
                found.update((min(node[a], node[b]), max(node[a], node[b])) for b in qs[_may_link(folded[a], list(folded[qs]), int(size[a]), size[qs])])
    return pd.DataFrame(sorted(found), columns=["a", "b"])


def missed_pairs(buckets: DataFrame, comps: DataFrame, bands: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a bucket, have near signatures and are in different components.

    comps: node, comp of the nodes in links (others are their own); bands: node, n, bands, sig, shingles.
    """
    known = buckets.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed_keys = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.approx_count_distinct("node").alias("m")).where("lo <> hi")
    blocks = mixed_keys.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("g"))
    rows = staged(known.join(blocks, "key"), "near-mixed")
    looks = bands.join(small(rows.select("node").distinct()), "node").dropDuplicates(["node"])
    rows = rows.join(looks.withColumn("folded", _folded("shingles")).drop("shingles"), "node")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    # block pairs (i, j) with i <= j: a node of block x is left in (x, j) and right in (i, x)
    cells = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct(F.least(k, F.col("at")).alias("i"), F.greatest(k, F.col("at")).alias("j")))
    rows = rows.withColumn("cell", F.explode(cells))
    rows = rows.select("key", "cell", "node", "comp", "n", "bands", "sig", "folded", (F.col("cell.i") == F.col("at")).alias("is_left"), (F.col("cell.j") == F.col("at")).alias("is_right"))
    return rows.groupBy("key", "cell").applyInPandas(_across, "a binary, b binary").distinct()


def node_components(hashed: DataFrame) -> DataFrame:
    """node, comp of the nodes that are in links; hashed: staged rows of SCHEMA."""
    first = hashed.where("bands is not null")
    buckets = first.select("node", F.explode("bands").alias("key"))
    # only buckets with two nodes matter; they are few, and are kept for the second look
    shared_keys = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key", F.col("lo").alias("a"))
    members = staged(buckets.join(shared_keys, "key").distinct(), "near-buckets")
    pairs = staged(members.where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct(), "near-stars")
    sets = first.select("node", "shingles")
    links = staged(confirmed(pairs, sets), "near-links")
    comps = connected_components(links)
    missed = staged(missed_pairs(members.select("key", "node"), comps, first.select("node", F.col("n_shingles").alias("n"), "bands", "sig", "shingles")).join(pairs, ["a", "b"], "left_anti"), "near-missed")
    if not missed.isEmpty():
        links = staged(links.union(confirmed(missed, sets)), "near-links")
        comps = connected_components(links)
    return comps


def hashed_rows(docs: DataFrame, id_col: str, text_col: str, width: int, with_locators: bool) -> DataFrame:
    locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")) if with_locators else F.lit(None).cast("struct<file: string, row: long>")
    return staged(in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), locator.alias("locator")).mapInArrow(lambda batches: _hashed(batches, width), SCHEMA), "near-hashed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    hashed = hashed_rows(docs, id_col, text_col, width, False)
    classes = hashed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = staged(classes.join(node_components(hashed), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-classes")
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "comp").select("node", "component_id")
    out = hashed.select("doc_id", "node", "n_shingles").join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with one row of each component, columns as they were: that with the smallest identifier, and of rows with
    the same one the first in the files. Rows without words stay."""
    docs = from_files(docs)
    hashed = hashed_rows(docs, id_col, text_col, width, True)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")
    nodes = hashed.where("node is not null").groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    nodes = staged(nodes.join(node_components(hashed), "node", "left"), "near-nodes")
    # a node is named only if it's in a component with others or has several rows; all rows of other nodes stay
    stays = nodes.where("comp is not null").groupBy("comp").agg(F.min("first").alias("stays"))
    named = nodes.where("comp is null and n > 1").select("node", F.col("first").alias("stays")).union(nodes.join(stays, "comp").select("node", "stays"))
    gone = hashed.where("node is not null").select("node", "locator", place.alias("place")).join(small(staged(named, "near-named")), "node").where(F.col("place") != F.col("stays"))
    return without(docs, staged(gone.select("locator"), "near-gone"))
