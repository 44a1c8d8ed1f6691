"""Global row numbers against Python's sort."""

import random

from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered


def test_numbers_follow_the_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1.0, 2.5, float(rng.randint(0, 50))]), "x") for i in range(3_000)]
    df = spark.createDataFrame(rows, "id int, v double, numbering_at string").repartition(7)
    got = {r.id: r.n for r in numbered(df, [F.desc_nulls_last("v"), F.asc("id")], "n").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}


def test_empty_and_ties(spark):
    df = spark.createDataFrame([], "id int")
    assert numbered(df, [F.asc("id")], "n").count() == 0
    same = spark.createDataFrame([(1,)] * 50, "id int").repartition(4)
    assert sorted(r.n for r in numbered(same, [F.asc("id")], "n").collect()) == list(range(1, 51))
