"""The automaton against a plain loop over all aliases."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import automaton as A, mentions as N
from tidemark.sources import files


def dictionary(rng, n, alphabet="abcd é_-9"):
    entities, seen = [], 0
    while seen < n:
        aliases = tuple(N.Alias("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))), rng.choice(N.MODES), rng.choice([0.3, 0.85, 1.0])) for _ in range(rng.randint(0, 4)))
        entities.append(N.Entity(f"e{len(entities):05d}", aliases))
        seen += max(1, len(aliases))
    return entities


@pytest.mark.parametrize("piece", [1, 7, 4_096])
def test_equals_a_loop(monkeypatch, piece):
    monkeypatch.setattr(A, "PIECE", piece)
    rng = random.Random(piece)
    for size in (0, 1, 5, 60):
        entities = dictionary(rng, size)
        machine, ids = A.of_entities(entities)
        texts = ["", "a", "é"] + ["".join(rng.choice("abcd é_-9ABx🎉\n") for _ in range(rng.randint(0, 60))).lower() for _ in range(150)]
        at, alias = machine.mentions(texts)
        got = [(int(t), ids[machine.aliases[i][0]], machine.aliases[i][2], machine.aliases[i][4]) for t, i in zip(at, alias, strict=True)]
        want = [(t, *m) for t, text in enumerate(texts) for m in N.reference_mentions(text, entities)]
        assert got == want


def test_equals_the_expression_and_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "No identifier: the CLOWN"), (-1, None), (-2, ""), (-3, "the " * 30_000)], "doc_id long, text string")
    rng = random.Random(3)
    words = sorted({w for r in docs.limit(40).collect() for w in r.text.lower().split()})
    entities = [N.Entity(f"e{i:03d}", tuple(N.Alias(rng.choice(words), rng.choice(N.MODES), rng.choice([0.5, 0.9])) for _ in range(3))) for i in range(12)]
    rows = docs.union(odd).repartition(3)
    want = sorted(map(repr, map(tuple, N.with_mentions(rows, F.col("text"), entities).drop("text").collect())))
    for given in (entities, files.alias_table(spark, entities)):
        assert sorted(map(repr, map(tuple, A.mentions_by_automaton(rows, F.col("text"), given, ["doc_id"]).collect()))) == want
    assert A.mentions_by_automaton(rows.limit(0), F.col("text"), entities, ["doc_id"]).count() == 0
    assert A.mentions_by_automaton(rows, F.col("text"), [], ["doc_id"]).count() == 0


def test_time_hardly_depends_on_the_dictionary():
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz "
    texts = ["".join(rng.choices(letters, k=2_000)) for _ in range(150)]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.arange(151) * 2_000
    spent = []
    for n in (100, 10_000):
        machine, _ = A.of_entities([N.Entity(str(i), (N.Alias("".join(rng.choices(letters[:26], k=9)), "substring"),)) for i in range(n)])
        machine.hits(points, offsets)
        start = time.thread_time()
        machine.hits(points, offsets)
        spent.append(time.thread_time() - start)
    assert spent[1] < 6 * spent[0]


def test_bounds(monkeypatch):
    monkeypatch.setattr(A, "CELLS", 100)
    with pytest.raises(ValueError, match="cells"):
        A.of_entities([N.Entity("e", (N.Alias("abcdefghijklmnop"),))])


@pytest.mark.parametrize("most", [1, 20, 1 << 19])
def test_slices_and_few_hits_at_once_equal_a_loop(monkeypatch, most):
    monkeypatch.setattr(A, "PIECE", 7)
    monkeypatch.setattr(A, "SLICE", most)
    monkeypatch.setattr(A, "HITS", most)
    rng = random.Random(most)
    nested = [N.Entity(m, tuple(N.Alias("a" * k, m, 0.5) for k in range(5, 0, -1))) for m in N.MODES] + [N.Entity("gate", (N.Alias("dab", "substring", 0.9),))]
    for entities in (nested, dictionary(rng, 60)):
        machine, ids = A.of_entities(entities)
        texts = ["", "a" * 40, "a" * 4 + " dab", "b aa"] + ["".join(rng.choice("aaabcd é_-9\n") for _ in range(rng.randint(0, 60))).lower() for _ in range(60)] + [""]
        at, alias = machine.mentions(texts)
        got = [(int(t), ids[machine.aliases[i][0]], machine.aliases[i][2], machine.aliases[i][4]) for t, i in zip(at, alias, strict=True)]
        assert got == [(t, *m) for t, text in enumerate(texts) for m in N.reference_mentions(text, entities)]


@pytest.mark.parametrize("text, aliases, mb", [("a" * 100_000, 64, 150), ("to be or not " * 1_000_000, 1, 320)])
def test_memory_follows_neither_hits_nor_long_texts(text, aliases, mb):
    machine, _ = A.of_entities([N.Entity("e", tuple(N.Alias("a" * k, "substring") for k in range(aliases, 0, -1)))])
    machine.mentions(["the table of letters"])
    tracemalloc.start()
    try:
        at, alias = machine.mentions([text, ""])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (at.tolist(), alias.tolist()) == (([0], [0]) if aliases > 1 else ([], []))
    assert peak < mb << 20, f"{peak >> 20} MB"
