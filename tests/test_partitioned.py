"""Merges by part against whole rewrites, with failures at every step."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts as X, rollups as U
from tidemark.streaming import partitioned as P

FACT = "id long, character_id string, sentiment string, sentiment_score double, sentiment_confidence double, intensity string, mention_weight double, created_at timestamp, kind string"


def batch(spark, rng, n, day=None):
    rows = []
    for _ in range(n):
        s = rng.choice(["positive", "negative", "mixed", "neutral"])
        rows.append((rng.randint(0, 150), rng.choice("abc"), s, {"positive": 1.0, "negative": -1.0}.get(s, 0.0), rng.random(), rng.choice(["low", "high"]), rng.random(), f"2020-12-{day or rng.randint(1, 31):02d} 12:00:00", rng.choice(["post", "comment"])))
    rows = list({(r[0], r[1]): r for r in rows}.values())  # a key once
    return spark.createDataFrame(rows, FACT.replace("created_at timestamp", "created_at string")).withColumn("created_at", F.to_timestamp("created_at"))


def rows_of(df):
    return sorted([tuple(round(v, 9) + 0.0 if isinstance(v, float) and v == v else str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()])


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_rollup_after_every_batch(spark, tmp_path):
    rng, key = random.Random(1), ["id", "character_id"]
    rollup = P.IncrementalRollup(spark, str(tmp_path), FACT, "id", key, buckets=8)
    whole = spark.createDataFrame([], FACT)
    for number in range(4):
        new = batch(spark, rng, 90, day=[None, 3, 31, None][number])
        rollup.add(number, new)
        whole = spark.createDataFrame(X.upsert(whole, new, key).collect(), FACT)
        assert rows_of(rollup.facts.read()) == rows_of(whole)
        assert rows_of(rollup.weekly()) == rows_of(U.weekly(whole))
        rollup.add(number, new)  # the batch comes again
        assert rows_of(rollup.weekly()) == rows_of(U.weekly(whole))


def test_sums_hold_all_digits_of_doubles(spark, tmp_path):
    # cut to 15 places, measures moved the mean of a week of orders from just below 0.0703125 onto the tie itself
    thirds = [(0.0, 0.5), (1.0, 0.6), (1.0, 0.7), (-1.0, 0.8), (-1.0, 0.9), (1.0, 0.8), (1.0, 0.7)]
    rows = [(i, "a", "mixed", s, c, "low", 1 / 3, "2020-12-09 12:00:00", "post") for i, (s, c) in enumerate(thirds * 40)]
    facts = spark.createDataFrame(rows, FACT.replace("created_at timestamp", "created_at string")).withColumn("created_at", F.to_timestamp("created_at"))
    rollup = P.IncrementalRollup(spark, str(tmp_path), FACT, "id", ["id", "character_id"], buckets=2)
    rollup.add(0, facts.where("id % 2 = 0"))
    rollup.add(1, facts.where("id % 2 = 1"))
    got = rollup.state.read().first()
    w = [1 / 3 * c for _, c in thirds * 40]
    assert abs(float(got.total) - math.fsum(w)) <= math.ulp(math.fsum(w))
    score = math.fsum(s * x for (s, _), x in zip(thirds * 40, w, strict=True))
    assert abs(float(got.score) - score) <= math.ulp(score)


def test_only_touched_parts_are_written(spark, tmp_path):
    rng = random.Random(2)
    rollup = P.IncrementalRollup(spark, str(tmp_path), FACT, "id", ["id", "character_id"], buckets=16, weeks=1)
    rollup.add(0, batch(spark, rng, 400))
    before = files_of(tmp_path / "weekly/data"), files_of(tmp_path / "facts/data")
    new = batch(spark, rng, 1, day=9)
    done = rollup.add(1, new.withColumn("id", F.lit(100_000).cast("long")))
    after = files_of(tmp_path / "weekly/data"), files_of(tmp_path / "facts/data")
    assert done["weeks"] == ["2020-49"] and len(done["facts"]) == 1
    for old, now in zip(before, after, strict=True):
        changed = {f.split("part=")[1].split("/")[0] for f in set(old.items()) ^ set(now.items()) for f in [f[0]]}
        assert len(changed) == 1


def test_hot_entity_is_in_all_parts(spark, tmp_path):
    rows = batch(spark, random.Random(3), 10).limit(1).crossJoin(spark.range(2_000).withColumnRenamed("id", "n")).withColumn("id", F.col("n")).drop("n")
    table = P.facts_table(spark, str(tmp_path / "t"), FACT, "id", buckets=8)
    P.merge_facts(table, 0, rows, ["id", "character_id"])
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "t/data")).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


class Lost(RuntimeError):
    pass


@pytest.mark.parametrize("step", ["pending", "overwrite", "mark", "facts"])
def test_failures_leave_nothing_undone_or_done_twice(spark, tmp_path, monkeypatch, step):
    rng, key = random.Random(5), ["id", "character_id"]
    first, second = batch(spark, rng, 80), batch(spark, rng, 80)
    rollup = P.IncrementalRollup(spark, str(tmp_path), FACT, "id", key, buckets=4)
    rollup.add(0, first)
    with monkeypatch.context() as m:
        if step == "pending":
            m.setattr(P, "added", lambda df: (_ for _ in ()).throw(Lost()))
        if step == "overwrite":
            read = P.PartitionedTable._read
            m.setattr(P.PartitionedTable, "_read", lambda self, path: (_ for _ in ()).throw(Lost()) if "pending" in path else read(self, path))
        if step == "mark":
            m.setattr(P.PartitionedTable, "_mark", lambda self, n: (_ for _ in ()).throw(Lost()))
        if step == "facts":
            m.setattr(P, "merge_facts", lambda *a: (_ for _ in ()).throw(Lost()))
        with pytest.raises(Lost):
            rollup.add(1, second)
    again = P.IncrementalRollup(spark, str(tmp_path), FACT, "id", key, buckets=4)
    again.add(1, second)
    whole = X.upsert(first, second, key)
    assert rows_of(again.facts.read()) == rows_of(whole)
    assert rows_of(again.weekly()) == rows_of(U.weekly(whole))


def test_wider_match_and_empty_batch(spark, tmp_path):
    table = P.facts_table(spark, str(tmp_path / "t"), "item string, alias string, v int", "item", buckets=4)
    make = lambda *rows: spark.createDataFrame(list(rows), "item string, alias string, v int")
    P.merge_facts(table, 0, make(("p", "x", 1), ("p", "y", 1), ("q", "x", 1)), ["item", "alias"])
    P.merge_facts(table, 1, make(("p", "z", 2)), ["item", "alias"], ["item"])
    assert P.merge_facts(table, 2, make(), ["item", "alias"]) == []
    assert sorted(map(tuple, table.read().collect())) == [("p", "z", 2), ("q", "x", 1)]
    assert P.merge_facts(table, 1, make(("p", "late", 3)), ["item", "alias"]) == []
