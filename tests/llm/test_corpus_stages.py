"""The pipeline's operators against brute force, and their edge cases."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import dedup, minhash, packing, quality, toxicity
from tidemark.llm.graph import connected_components
from tidemark.llm.shared import shared_dir, small

WS = " \t\n\x0b\x0c\r"
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "A  b\tc d"), (8, "a b c d"),
    (9, "x y " * 30_000), (10, "ééé \x00 \U0001f600   z"), (11, "<|endoftext|> tail"), (12, "q" * 3000), (13, "   "), (14, "a b c d"),
]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # columns whose names may clash with those an operator makes
        df = df.select("*", F.lit("en").alias("lang"), *[F.lit(i).alias(c) for i, c in enumerate(("n", "digest", "norm", "keep", "node", "bands", "grp", "kept", "p_toxic", "n_words", "cutoff"))])
    return df


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def norm(t):
    out, space = [], False
    for c in t or "":
        if c in WS:
            if not space:
                out.append(" ")
            space = True
        else:
            out.append(c)
            space = False
    return "".join(out)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return sorted((i, min(groups[norm(t)]), len(groups[norm(t)])) for i, t in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    kw = {"digest": lambda c: (F.crc32(c.cast("binary")) % 3).cast("string")} if weak else {}
    got = dedup.exact_duplicates(frame(spark, ODD), **kw).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == brute_exact(ODD)
    assert sum(r.kept for r in got) == len({norm(t) for _, t in ODD})
    import hashlib

    texts = dict(ODD)
    assert all(r.text_sha256 == hashlib.sha256(norm(texts[r.doc_id]).encode()).hexdigest() for r in got)


def test_exact_state_goes_on(spark):
    state, texts = dedup.StreamingDeduplicator(spark), []
    row = lambda i, d: (i, ("f", i), d)
    for part in ([row(5, "a"), row(6, "b")], [row(3, "a"), row(9, "c"), row(2, "b")], [row(8, "a"), row(7, "b")]):
        state.add(spark.createDataFrame(part, dedup.KEYS))
        texts += [(k, "other" if i == 7 else f"text {d}") for i, k, d in part]  # 7 has the digest of b, but not its bytes
        state.advance(spark.createDataFrame(texts, "locator struct<file: string, row: long>, norm string"))
    assert sorted((r.digest, r.keep.doc_id, r.n) for r in state.groups().collect()) == [("a", 3, 3), ("b", 2, 3), ("c", 9, 1)]
    # each hit is compared once, in the batch that makes it one
    checked = sorted((r.batch, r.locator.row, r.equal) for r in state._checked().collect())
    assert checked == [(1, 5, True), (1, 6, True), (2, 7, False), (2, 8, True)]
    assert [(r.locator.row, r.digest) for r in state.differing().collect()] == [(7, "b")]


def test_another_text_comes_to_stay(spark):
    """Rows found equal to the row that stayed are looked at again when one with another text comes in its place."""
    state, texts = dedup.StreamingDeduplicator(spark), []
    for part in ([(5, "X"), (6, "X")], [(1, "Y")], [(7, "X"), (8, "Y"), (0, "Y")]):
        keys = [(i, ("f", i), "d") for i, _ in part]
        state.add(spark.createDataFrame(keys, dedup.KEYS))
        texts += [(("f", i), t) for i, t in part]
        state.advance(spark.createDataFrame(texts, "locator struct<file: string, row: long>, norm string"))
        stays = min((k[1], t) for k, t in texts)[1]
        assert sorted(r.locator.row for r in state.differing().collect()) == sorted(k[1] for k, t in texts if t != stays)


def test_random_stream_with_a_weak_digest(spark):
    rng = random.Random(11)
    state, texts = dedup.StreamingDeduplicator(spark), []
    for _ in range(4):
        part = [(rng.randint(0, 10**6), rng.choice("XYZ")) for _ in range(12)]
        state.add(spark.createDataFrame([(i, ("f", i), str(i % 2)) for i, _ in part], dedup.KEYS))
        texts += part
        state.advance(spark.createDataFrame([(("f", i), t) for i, t in texts], "locator struct<file: string, row: long>, norm string"))
        stays = {d: min((i, t) for i, t in texts if i % 2 == d)[1] for d in {i % 2 for i, _ in texts}}
        assert sorted(r.locator.row for r in state.differing().collect()) == sorted(i for i, t in texts if t != stays[i % 2])


def test_a_null_identifier_stays_only_alone(spark):
    rows = [(None, "a"), (5, "a"), (3, "a "), (None, "b"), (None, "b"), (4, None), (None, "")]
    got = dedup.exact_duplicates(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 5, 2, False), (5, 5, 2, True), (3, 3, 1, True), (None, None, 2, True), (None, None, 2, False), (4, 4, 2, True), (None, 4, 2, False)]))


def test_large_groups_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dedup, "GROUP_ROWS", 7)
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(200)]
    for kw in ({}, {"digest": lambda c: F.length(c).cast("string")}):
        got = dedup.exact_duplicates(frame(spark, rows), **kw).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == brute_exact(rows)


def test_empty_tables(spark):
    none, nolabels = frame(spark, [], False).withColumn("lang", F.lit("en")), labels_of(spark, [])
    assert dedup.exact_duplicates(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert quality.quality_verdicts(none, nolabels).count() == 0
    assert toxicity.toxicity_scores(none, nolabels).count() == 0
    assert packing.packed(none, *codec()).count() == 0
    for keep in (dedup.drop_exact_duplicates, minhash.drop_near_duplicates, lambda d: quality.keep_quality(d, nolabels), lambda d: toxicity.drop_toxic(d, nolabels)):
        assert keep(none).columns == none.columns and keep(none).count() == 0


def test_odd_rows_pass_every_stage(spark):
    docs, labels = frame(spark, ODD), labels_of(spark, [(4, 1, 0), (6, 0, 1), (6, None, None), (None, 1, 1)])
    for keep in (dedup.drop_exact_duplicates, minhash.drop_near_duplicates, lambda d: quality.keep_quality(d, labels), lambda d: toxicity.drop_toxic(d, labels)):
        out = keep(docs)
        assert out.columns == docs.columns
        out.collect()
    assert quality.quality_verdicts(docs, labels).count() == len(ODD)
    assert toxicity.toxicity_scores(docs, labels).count() == len(ODD)


def shingles(t, width=2):
    w = [x for x in "".join(c if c not in WS else " " for c in (t or "")).translate({i: i + 32 for i in range(65, 91)}).split(" ") if x]
    return frozenset([tuple(w)] if 0 < len(w) < width else (tuple(w[i : i + width]) for i in range(len(w) - width + 1)))


def brute_near(rows, width=2):
    sets = {i: shingles(t, width) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        if s:
            by[s].append(i)
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(i, j):
        i, j = sorted((top(i), top(j)))
        up[j] = i

    for ids in by.values():
        for i in ids[1:]:
            join(ids[0], i)
    inverted = defaultdict(list)
    distinct = list(by)
    for k, s in enumerate(distinct):
        for g in s:
            inverted[g].append(k)
    for k, s in enumerate(distinct):
        for j, c in Counter(j for g in s for j in inverted[g] if j < k).items():
            if 100 * c >= 80 * (len(s) + len(distinct[j]) - c):
                join(by[s][0], by[distinct[j]][0])
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets.items())


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"m{rng.randrange(10**6)}"
    return words


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows, i = [(i, t) for i, t in ODD if i != 4] + [(4, "one")], 100
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 12, 40, 150]))]
        for _ in range(rng.choice([1, 2, 8, 25])):
            rows.append((i, " ".join(mutated(rng, base, rng.randrange(0, 1 + len(base) // 12)))))
            i += 1
    for _ in range(150):  # one passage in many documents
        rows.append((i, " ".join(passage + [rng.choice(vocab) for _ in range(40)])))
        i += 1
    for width in (2, 5):
        got = minhash.near_duplicates(frame(spark, rows), width=width).select("doc_id", "n_shingles", "component_id", "kept")
        assert sorted(map(tuple, got.collect())) == brute_near(rows, width)


def pairs_at_the_limit(rng, sizes, n):
    """Texts in pairs whose sets of two-word shingles have the lowest similarity of at least 0.8 that their size allows."""
    rows = []
    for _ in range(n):
        size = rng.choice(sizes)
        words = [f"w{rng.randrange(10**9)}" for _ in range(size + 1)]
        k = size // 9  # (size - k) / (size + k) >= 0.8
        other = words[: len(words) - k] + [f"w{rng.randrange(10**9)}" for _ in range(k)] if k else words[:-1]
        rows += [" ".join(words), " ".join(other)]
    return list(enumerate(rows))


@pytest.mark.parametrize("sizes", [range(5, 11), range(11, 51), range(51, 400)])
def test_recall_by_set_size(spark, sizes):
    rows = pairs_at_the_limit(random.Random(6), sizes, 400)
    got = minhash.near_duplicates(frame(spark, rows), width=2).select("doc_id", "component_id").collect()
    assert sum(r.component_id != r.doc_id for r in got if r.doc_id % 2) >= 399 and all(r.component_id == r.doc_id for r in got if r.doc_id % 2 == 0)


def test_near_duplicates_are_dropped_by_row(spark):
    texts = {"a": " ".join(f"a{k}" for k in range(60)), "b": " ".join(f"b{k}" for k in range(60)), "c": " ".join(f"c{k}" for k in range(60))}
    rows = [(3, texts["a"]), (4, texts["a"]), (4, texts["b"]), (7, texts["c"]), (7, texts["c"]), (None, texts["b"]), (None, "alone"), (9, None), (9, " ")]
    got = sorted(map(str, (tuple(r) for r in minhash.drop_near_duplicates(frame(spark, rows, False)).collect())))
    assert got == sorted(map(str, [(3, texts["a"]), (4, texts["b"]), (7, texts["c"]), (None, "alone"), (9, None), (9, " ")]))


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, minhash.near_duplicates(docs, width=2).collect()))
    assert got == brute_near(rows)
    assert minhash.drop_near_duplicates(docs, width=2).count() == sum(r[3] for r in brute_near(rows))


def test_a_node_of_many_tasks_has_one_set(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(i, text + (" more" if i % 2 else "")) for i in range(120)], "doc_id long, text string").repartition(60)
    hashed = minhash.hashed_rows(docs, "doc_id", "text", 2, False)
    sets = hashed.where("bands is not null").select("node", "shingles")
    nodes = sorted(r.node for r in sets.select("node").distinct().collect())
    pairs = spark.createDataFrame([tuple(nodes)], "a binary, b binary")
    assert len(nodes) == 2 and sets.count() > 2 and minhash.held_sets(pairs, sets).count() == 2
    assert [tuple(r) for r in minhash.confirmed(pairs, sets).collect()] == [tuple(nodes)]


def test_missed_pairs_finds_what_a_star_loses(spark):
    # one bucket of three nodes whose centre a is similar to neither b nor c
    bands, sets = {b"a": [1, 9, 8], b"b": [1, 2, 3], b"c": [1, 2, 4]}, {b"a": range(50), b"b": range(100, 150), b"c": range(102, 152)}
    buckets = spark.createDataFrame([(1, bytearray(n)) for n in bands], "key long, node binary")
    rows = [(bytearray(n), 50, b, bytearray(b * 80), [x << 8 for x in sets[n]]) for n, b in bands.items()]
    looks = spark.createDataFrame(rows, "node binary, n long, bands array<long>, sig binary, shingles array<long>")
    none = spark.createDataFrame([], "node binary, comp binary")
    assert [(bytes(r.a), bytes(r.b)) for r in minhash.missed_pairs(buckets, none, looks).collect()] == [(b"b", b"c")]
    together = spark.createDataFrame([(bytearray(b"b"), bytearray(b"b")), (bytearray(b"c"), bytearray(b"b"))], "node binary, comp binary")
    assert minhash.missed_pairs(buckets, together, looks).count() == 0
    # a bucket of another band, in which the pair isn't looked at again
    assert minhash.missed_pairs(buckets.withColumn("key", F.lit(2).cast("long")).where("node <> 'a'"), none, looks).count() == 0


def test_missed_pairs_with_a_chance_agreement_in_an_earlier_band(spark):
    # the first band agrees in its low 16 bits only, so no bucket holds the pair there
    bands, sets = {b"b": [1, 9, 2], b"c": [1 + (1 << 16), 9, 2]}, {b"b": range(100, 150), b"c": range(102, 152)}
    rows = [(bytearray(n), 50, b, bytearray(b"b" * 240), [x << 8 for x in sets[n]]) for n, b in bands.items()]
    looks = spark.createDataFrame(rows, "node binary, n long, bands array<long>, sig binary, shingles array<long>")
    buckets = spark.createDataFrame([(9, bytearray(n)) for n in bands], "key long, node binary")
    none = spark.createDataFrame([], "node binary, comp binary")
    assert [(bytes(r.a), bytes(r.b)) for r in minhash.missed_pairs(buckets, none, looks).collect()] == [(b"b", b"c")]


def test_folded_sets_rule_out_no_link():
    rng = np.random.default_rng(3)
    for size in (5, 300, 1_900, 2_100, 6_000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            k = rng.integers(0, max(1, size // 4))
            y = np.unique(np.concatenate([x[k:], rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 8), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                fold = [np.unique((v >> np.uint64(8)).astype(np.uint16 if len(v) <= minhash.FOLD_LIMIT else np.uint32)).tobytes() for v in (x, y)]
                assert minhash._may_link(fold[0], [fold[1]], len(x), np.array([len(y)]))[0] and minhash._may_link(fold[1], [fold[0]], len(y), np.array([len(x)]))[0]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (3, 40, 2_000):
        est, true = [], []
        for _ in range(60):
            both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (size, max(1, size // 8), max(1, size // 8)))
            x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
            est.append((minhash.signature(x) == minhash.signature(y)).mean())
            true.append(len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(est) - np.mean(true)) < 0.04


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 180), rng.randrange(100, 180)) for _ in range(60)] + [(7, 7), (None, 3)]
    up = {}

    def top(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((i, top(i)) for i in up)


def codec():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def library_ids(texts):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_packing_round_trip(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, (_, t) in enumerate(ODD)]
    rows += [(20_000, "<|endoftext|>"), (20_001, "a <|endoftext|><|endoftext|> b<|endoftext|"), (20_002, "<|ENDOFTEXT|> <|endoftext|>\n")]
    ids = dict(zip([i for i, _ in rows], library_ids([t for _, t in rows]), strict=True))
    special = packing.special_tokens(codec()[0].replace(".tiktoken", ".json"))
    assert special == {"<|endoftext|>": 50_256} and 50_256 in ids[20_000]
    got = packing.packed(frame(spark, rows), *codec(), special=special).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    for parts, size in [(pieces[i], len(v)) for i, v in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == size if size else at <= 1024 and at & (at - 1) == 0


def test_groups_of_short_texts_are_bounded(spark):
    """Groups follow rows as well as characters."""
    n = 200_000
    got = packing.packed(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), *codec()).agg(F.sum("length").alias("tokens"), F.count_distinct(F.shiftright("sequence_id", 32)).alias("groups")).first()
    assert got.tokens == n and got.groups == -(-n * packing.ROW_CHARS // packing.GROUP_CHARS)


def test_pack_takes_the_cheapest_sequence_with_room():
    assert packing.pack([324, 600, 700, 424]) == [(2, 0, 700, 0, 0), (1, 0, 600, 1, 0), (3, 0, 424, 1, 600), (0, 0, 324, 0, 700)]
    rng = random.Random(3)
    lengths = [rng.randrange(1, 1024) for _ in range(3_000)]
    pieces = packing.pack(lengths)
    assert len(pieces) - len(lengths) <= -(-sum(lengths) // 1024) + 10  # a cut fills a sequence


def brute_counts(t):
    text = t or ""
    words = norm(text).strip(" ").split(" ") if norm(text).strip(" ") else []
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(WS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_rule_counts():
    rng = random.Random(4)
    texts = [t for _, t in ODD] + ["".join(rng.choice("ab \n#é|\t") for _ in range(rng.randrange(200))) for _ in range(400)]
    for t in texts:
        assert quality.rule_counts(t) == brute_counts(t)


def test_binomial_and_cutoff():
    from math import comb

    for n, k, p in [(10, 3, 0.2), (200, 4, 0.03), (5, 5, 0.5)]:
        assert quality.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    s = np.array([0, 5, 300, 900])
    assert quality.certified_cutoff(s, np.array([990, 10, 0, 0]), np.array([0, 0, 30, 40]), 0.03, 0.0125) == 153
    assert quality.certified_cutoff(s, np.array([20, 0, 0, 0]), np.array([0, 0, 30, 40]), 0.03, 0.0125) is None  # too few
    assert quality.certified_cutoff(s, np.array([900, 0, 0, 100]), np.array([0, 0, 30, 0]), 0.03, 0.0125) is None


def test_false_rejections_stay_below_alpha():
    rng = np.random.default_rng(6)
    over = 0
    for _ in range(300):  # the share of good documents at or above 400 is 0.05, over alpha
        x = rng.choice([0, 400, 800], size=400, p=[0.95, 0.05, 0.0])
        s, c = np.unique(x, return_counts=True)
        over += quality.certified_cutoff(s, c, np.where(s > 0, 1000, 0), 0.03, 0.05) is not None
    assert over / 300 < 0.07


def test_quality_rejects_junk_and_keeps_good(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(400)]
    junk = [(1000 + i, " ".join(f"w{i}x{k}###" for k in range(60))) for i in range(60)]
    labels = labels_of(spark, [(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(40)])
    docs = frame(spark, good + junk, False).withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in quality.keep_quality(docs, labels).collect()}
    assert kept == {i for i, _ in good}


@pytest.mark.parametrize(("sf", "recall"), [("sf0.1", 0.9), ("sf0.01", 0.5)])
def test_chain_on_held_out_documents(spark, sf, recall):
    """The flag that is shipped, on labelled documents that the chain and its threshold haven't seen."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "is_toxic")
    p = toxicity.toxicity_scores(docs, train).join(test, "doc_id").select("p_low_quality", "quality", "toxic", "is_toxic").toPandas()
    bad = p.is_toxic == 1
    print(sf, (p.toxic & bad).sum(), "of", bad.sum(), "and", (p.toxic & ~bad).sum(), "of", (~bad).sum())
    assert (p.toxic & bad).sum() >= recall * bad.sum()
    assert (p.toxic & ~bad).sum() <= (0.005 if sf == "sf0.1" else 0.05) * (~bad).sum()
    assert ((p.p_low_quality >= 0.5) == (p.quality == 0)).mean() > 0.95


def test_chain_feeds_out_of_fold_probabilities():
    rng = random.Random(7)
    first = [rng.random() < 0.4 for _ in range(600)]
    vocabulary = [b"bad", *(f"n{i}".encode() for i in range(50))]
    words = [sorted(({0} if f else set()) | {1 + rng.randrange(50) for _ in range(5)}) for f in first]
    labels = np.array([[f, f] for f in first], float)
    labels[::50, 1] = np.nan
    chain = toxicity.fit_chain(words, vocabulary, np.full((600, 3), 0.1), labels, np.arange(600), ("a", "b"))
    assert len(chain.models[1].dense) == len(chain.models[0].dense) + 1
    assert chain.models[1].dense[-1] > 0.5
    assert chain.predict(["it is bad", "it is fine"])[0, 1] > 0.5 > chain.predict(["it is bad", None])[1, 1]


def brute_logistic(x, y, test):
    """Regularised logistic regression by plain steps over a full table; probabilities for the rows of test."""
    w = [0.0] * x.shape[1] + [math.log(y.mean() / (1 - y.mean()))] if 0 < y.mean() < 1 else None
    if w is None:
        return np.full(len(test), 1 / (1 + math.exp(40.0 if y.mean() == 0 else -40.0)))
    w, m, v = np.array(w), 0.0, 0.0
    ones = lambda t: np.hstack([t, np.ones((len(t), 1))])
    for step in range(1, toxicity.STEPS + 1):
        g = ones(x).T @ (1 / (1 + np.exp(-ones(x) @ w)) - y) / len(y) + toxicity.L2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - 0.2 / (1 + step / 50) * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return 1 / (1 + np.exp(-ones(test) @ w))


def brute_chain(rows, labels):
    """Probabilities and flags of all rows, from the definition of the chain; labels: id to (low quality, toxic)."""
    split = lambda t: "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (t or "").lower()).split(" ")
    features = {}
    for i, t in rows:
        words = {w.encode() for w in split(t) if w}
        features[i] = words | {w[:n] + b"*" for w in words for n in toxicity.PREFIXES if len(w) > n}
    dense = {i: toxicity.dense_of(t, sum(bool(w) for w in split(t))) for i, t in rows}
    h = {r.i: r.h for r in spark_hashes([i for i, _ in rows])}
    sample, seen = [], set()
    for i in sorted(labels, key=lambda i: (h[i], i)):
        if (key := frozenset(features[i])) not in seen:
            seen.add(key)
            sample.append(i)
    y = np.array([labels[i] for i in sample], float)
    counts = Counter(w for i in sample for w in features[i])
    chosen = set()
    for k in range(2):
        hits, rate = Counter(w for i, t in zip(sample, y[:, k], strict=True) if t for w in features[i]), y[:, k].mean()
        strength = {w: abs(hits[w] - n * rate) / math.sqrt(max(n * rate * (1 - rate), 1e-9)) for w, n in counts.items() if n >= toxicity.MIN_DOCS}
        chosen |= set(sorted(strength, key=lambda w: (-round(strength[w], 9), w))[: min(toxicity.MOST, max(toxicity.LEAST, len(sample) // toxicity.PER_WORD))])
    chosen = sorted(chosen)
    table = lambda ids: np.array([[w in features[i] for w in chosen] + dense[i] for i in ids], float)
    x, every, fold = table(sample), table([i for i, _ in rows]), np.array([h[i] % toxicity.FOLDS for i in sample])
    out = []
    for k in range(2):
        oof = np.zeros(len(sample))
        for f in range(toxicity.FOLDS):
            oof[fold == f] = brute_logistic(x[fold != f], y[fold != f, k], x[fold == f])
        out.append(brute_logistic(x, y[:, k], every))
        x, every = np.hstack([x, oof[:, None]]), np.hstack([every, out[-1][:, None]])
    scores = {t: ((oof >= t) & (y[:, 1] == 1)).sum() - toxicity.FALSE_ALARM * ((oof >= t) & (y[:, 1] == 0)).sum() for t in oof}
    top = max(scores, key=lambda t: (scores[t], t))
    threshold = (top + max([t for t in scores if t < top], default=0.0)) / 2
    return [(i, a, b, b >= threshold) for (i, _), a, b in zip(rows, *out, strict=True)]


def spark_hashes(ids):
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame([(i,) for i in ids], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(1 << 30)).alias("h")).collect()


def test_chain_against_its_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    marks = {r.doc_id: (1 - r.quality, r.toxic) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    got = toxicity.toxicity_scores(docs, labels_of(spark, [(i, 1 - a, b) for i, (a, b) in marks.items()])).orderBy("doc_id").collect()
    for g, w in zip(got, brute_chain(rows, marks), strict=True):
        assert g.doc_id == w[0] and (g.p_low_quality, g.p_toxic) == pytest.approx(w[1:3], abs=2e-5) and g.toxic == w[3]


def test_sample_is_bounded_by_rows(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 40)]
    marks = toxicity.label_categories(labels_of(spark, [(i, 1, i % 2) for i in range(1, 40)]))
    got = toxicity.sample_of(frame(spark, rows), marks, toxicity.CATEGORIES, "doc_id", "text", 1_000)
    assert got.count() == 39 and toxicity.sample_of(frame(spark, rows), marks, toxicity.CATEGORIES, "doc_id", "text", 10).count() == 10


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert "BroadcastHint" not in str(small(spark.range(5), 3)._jdf.queryExecution().logical().toString())


def test_a_scope_deletes_its_own_tables_only(spark):
    from tidemark import staging
    from tidemark.llm import shared

    before = quality.quality_verdicts(frame(spark, ODD), labels_of(spark, []))
    with shared.scope(spark) as outer:
        one = shared.staged(spark.range(3), "some")
        with shared.scope(spark) as inner:
            two = shared.staged(spark.range(4), "some")
            assert two.count() == 4 and len(inner) == 1
        assert one.count() == 3 and os.path.isdir(outer[0]) and not os.path.exists(inner[0])
    assert not os.path.exists(outer[0]) and not staging._SCOPES
    assert before.count() == len(ODD)


def test_sides_are_broadcast_by_rows_and_bytes(spark):
    from tidemark.llm import shared

    hinted = lambda df, *a: "hint" in df._jdf.queryExecution().logical().toString().lower()
    df = spark.range(10).select("id", F.expr("repeat('x', 1000)").alias("t"), F.array(F.struct("id", F.lit("ab").alias("s"))).alias("l"))
    assert hinted(shared.small(df)) and not hinted(shared.small(df, 9)) and not hinted(shared.small(df, 10, 5_000))


def test_names_that_clash(spark):
    labels = labels_of(spark, [(6, 1, 0)])
    docs = frame(spark, ODD).withColumns({c: F.lit(0) for c in ("q_n_words", "Q_kept", "t_p_toxic", "__t_p", "__locator", "__gone", "locator_of", "__id")})
    for keep in (dedup.drop_exact_duplicates, minhash.drop_near_duplicates, lambda d: quality.keep_quality(d, labels), lambda d: toxicity.drop_toxic(d, labels)):
        out = keep(docs)
        assert out.columns == docs.columns
        out.collect()


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == columns
        path = f"{shared_dir(spark)}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        before, docs = docs, spark.read.parquet(path)
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert ids == [r[0] for r in brute_near(rows, 5) if r[3]]
        if name == "exact_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert ids == sorted({k for _, k, _ in brute_exact(rows)})
    assert 300 < len(ids) < 1000 and all(texts[i] for i in ids)
    got = corpus_pipeline.run(spark, d)
    assert sorted(r.doc_id for r in got.select("doc_id").distinct().collect()) == ids
    left = [f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("pipeline-")]
    assert len(left) == 1 and left[0].startswith("pipeline-packing")
