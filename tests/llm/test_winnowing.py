"""Winnowing against a plain restatement with the hash library."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import winnowing as W

MASK = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def brute_force(text: str | None, k: int = W.K, window: int = W.WINDOW) -> list[tuple[int, int]]:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    runs = []
    for i in range(max(1, len(words) - k + 1) if words else 0):
        h = 0
        for x in hashes[i : i + k]:
            h = (h << 1 & MASK) ^ x
        runs.append(signed(h) >> 31)
    chosen = set()
    for i in range(max(1, len(runs) - window + 1) if runs else 0):
        part = runs[i : i + window]
        chosen.add(max(j for j in range(i, i + len(part)) if runs[j] == min(part)))
    return sorted((j, runs[j]) for j in chosen)


def said(found: list[tuple[int, int]]) -> str:
    return " ".join(f"{h}@{j}" for j, h in sorted(found))


def like(a: list, b: list) -> float:
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


ODD = [None, "", "  \n", "one", "One two THREE", "a b c d e", "a b c d e f", "same " * 40, "été élève\x0bça " * 9, "x" * 50_000, "w1 w2 " * 3_000, "a b c d e f g h i j k l m", " lead and trail \t"]


@pytest.mark.parametrize(("k", "window"), [(5, 8), (1, 1), (2, 3), (7, 5), (4, 16)])
def test_choice(spark, k, window):
    rng = random.Random(k)
    texts = ODD + [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r.i: r.s for r in rows.select("i", W.spelled(W.fingerprint(F.col("text"), k, window)).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert sorted(got[i].split()) == sorted(said(brute_force(text, k, window)).split()), text


def expected(docs: list[tuple]) -> list[tuple]:
    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mine, other, changed = brute_force(text), brute_force(after), brute_force(edited)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), said(mine), said(changed), like(mine, changed), like(mine, other)))
    return out


@pytest.mark.parametrize("range_bytes", [W.RANGE_BYTES, 2_000])
def test_compared_with_edited_and_next(spark, sf, monkeypatch, range_bytes):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_000 + 7 * i, t) for i, t in enumerate(ODD)] + [(None, "no identifier"), (None, None), (5, "the same identifier"), (5, "the same identifier"), (-3, "first of all 🎉 " * 20), ((1 << 63) - 1, "largest")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(W.with_next, "__defaults__", (range_bytes,))
    got = [(*r[:3], *(" ".join(sorted(s.split(), key=lambda x: int(x.partition("@")[2]))) for s in r[3:5]), *r[5:]) for r in map(tuple, W.compared(rows).collect())]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(docs)))


def test_shared_passage_is_always_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(W.K + W.WINDOW - 1))
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) + f" {passage} " + " ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    sets = [set(r[0]) for r in rows.select(W.hashes_of(W.fingerprint(F.col("text")))).collect()]
    assert all(sets[0] & s for s in sets)


def test_empty_single_and_clashing(spark):
    assert W.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = W.compared(spark.createDataFrame([(1, "only one", "x", 2)], "doc_id long, text string, chosen string, next_text long")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_plan_is_native(spark, sf):
    plan = W.compared(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|BroadcastNestedLoop|Cartesian", plan)
