"""Resampling against a plain restatement."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text: str | None, buckets: int = R.BUCKETS) -> list[int]:
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for i in range(len(w)) for k in (1, 2, 3) if i + k <= len(w)]


def brute_force(docs: list[tuple], target: list[str | None]) -> list[tuple]:
    s = collections.Counter(b for _, t in docs for b in buckets_of(t))
    t = collections.Counter(b for x in target for b in buckets_of(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for doc, text in docs:
        found = buckets_of(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    long_enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(long_enough[: 5 * len(long_enough) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


ODD = [None, "", "...", "Hello", "A" * 300 + " b " + "c" * 70, "é日本 x9" * 40, "word\x00other", "1 2 3 " * 4_000, "z" * 100_000, "UPPER lower MiXed-Case_and_more"]


def test_streams_of_every_kind():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abc ABC.é日9") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    words, out, at = R.bucket_streams(*R.text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert words[i] == len(words_of(t))
        assert sorted(out[at[i] : at[i + 1]].tolist()) == sorted(buckets_of(t)), t


def test_crc_of_joined_strings():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randint(0, 80)), rng.randbytes(n)) for n in (0, 1, 5, 63, 64, 65, 127, 128, 4_096, 70_001)]
    first, second = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    got = R.appended(first, second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_equals_a_plain_restatement(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(5_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no identifier " * 12), (7, "tie " * 30), (8, "tie " * 30), (None, None)] + [(20_000 + i, "some clean words for a longer document " * 4) for i in range(200)]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, ""]
    got = R.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_force(docs, target)))


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resampled(none, none).count() == 0
    docs = spark.createDataFrame([(i, "a b c " * 10, 1, "x", 2) for i in range(40)], "doc_id long, text string, rank int, buckets string, place int")
    got = R.resampled(docs, none.select("text")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 40
    # repeated rows are drawn on their own
    again = R.resampled(docs.union(docs), none.select("text")).collect()
    assert sorted(r["rank"] for r in again if r["rank"]) == [1, 2, 3, 4] and len(again) == 80
