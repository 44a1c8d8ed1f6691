import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts as X, silver as S
from tidemark.schemas import empty, schema
from tidemark.sources import archive, files, live
from tidemark.streaming import incremental as I


def row(i, at):
    return {"id": str(i), "created_utc": at}


def test_pages():
    data = [row(i, t) for i, t in enumerate([1, 2, 2, 2, 3, 9])]
    fetch = lambda n: lambda cursor: [r for r in data if r["created_utc"] >= cursor][:n]
    assert [r["id"] for r in archive.pages(fetch(100), 0)] == list("012345")
    assert [r["id"] for r in archive.pages(fetch(3), 0)] == list("01245")  # a cut second loses a row
    assert [r["id"] for r in archive.pages(fetch(3), 0, overlap=True)] == list("012345")[:4]
    assert [r["id"] for r in archive.pages(fetch(4), 0, overlap=True)] == list("012345")
    assert list(archive.pages(lambda c: [], 0)) == []
    assert len(list(archive.pages(lambda c: [row(c, c)], 0, max_pages=5))) <= 5
    assert [r["id"] for r in archive.pages(lambda c: [row(1, 1)], 5)] == ["1"]  # a cursor that stands still


def test_archive_source(spark, tmp_path):
    (tmp_path / "posts").mkdir()
    for c in ("a", "b"):
        (tmp_path / "posts" / f"{c}.json").write_text(json.dumps([{"id": f"{c}{i}", "subreddit": c, "created_utc": i, "title": "t", "score": str(i), "extra": 1} for i in range(250)]))
    spark.dataSource.register(archive.ArchiveSource)
    df = spark.read.format("archive").options(kind="posts", communities="a, b,none", path=str(tmp_path), after=10, before=240).load()
    assert df.rdd.getNumPartitions() == 3
    posts = S.archive_posts(df, datetime(2024, 1, 1))
    assert posts.count() == 460 and posts.agg(F.sum("score")).first()[0] == 2 * sum(range(10, 240))
    root = str(tmp_path / "bronze")
    files.append_bronze(posts, root, "posts")
    files.append_bronze(posts.limit(5), root, "posts")
    assert files.partitioned_bronze(spark, root, "posts").where("ingest_date = date'2024-01-01'").count() == 465
    assert files.partitioned_bronze(spark, root, "comments").count() == 0 == files.bronze(spark, str(tmp_path / "none"), "posts").count()


def test_live_source_goes_on_from_its_marks(spark, tmp_path):
    (tmp_path / "posts").mkdir()
    feed = tmp_path / "posts" / "a.json"
    feed.write_text(json.dumps([row(i, 10 + i) for i in range(3)]))
    spark.dataSource.register(live.LiveSource)
    got = []

    def run():
        s = spark.readStream.format("live_feed").options(kind="posts", communities="a,missing", path=str(tmp_path)).load()
        q = s.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).foreachBatch(lambda b, n: got.extend(r.id for r in b.select("id").collect())).start()
        q.awaitTermination()

    run()
    feed.write_text(json.dumps([row(i, 10 + i) for i in range(5)]))
    run()
    run()
    assert sorted(got) == list("01234")
    assert live.newer([row(1, 5), row(2, 3)], 4) == ([row(1, 5)], 5) and live.newer([], 7) == ([], 7)
    with pytest.raises(RuntimeError, match="B"):
        live.credentials(("A", "B"), {"A": "x"})
    assert live.credentials(("A",), {"A": "x"}) == {"A": "x"}


def bronze(spark, items):
    names = schema("bronze_posts").names
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in items], schema("bronze_posts"))


def test_incremental_silver(spark, tmp_path):
    root, silver = tmp_path / "bronze", str(tmp_path / "silver")

    def drop(k, items):
        bronze(spark, items).coalesce(1).write.parquet(str(tmp_path / f"new{k}"))
        (root / f"day{k}").mkdir(parents=True)
        next((tmp_path / f"new{k}").glob("part-*.parquet")).rename(root / f"day{k}" / f"posts.{k}.parquet")

    each = I.merge_silver(silver, "silver_posts", lambda b: S.silver_posts(b, "s"))
    go = lambda: I.run_available(I.new_files(spark, str(root), "posts"), str(tmp_path / "cp"), each)
    drop(1, [{"id": "a", "title": "early", "retrieved_at": datetime(2024, 1, 1)}, {"id": "b", "title": "b", "retrieved_at": datetime(2024, 1, 1)}])
    go()
    drop(2, [{"id": "a", "title": "late", "retrieved_at": datetime(2024, 1, 2)}, {"id": "c", "title": "c", "retrieved_at": datetime(2024, 1, 2)}])
    go()
    go()
    assert sorted((r.id, r.title) for r in files.table(spark, silver, "silver_posts").collect()) == [("a", "late"), ("b", "b"), ("c", "c")]


def test_incremental_facts_and_weeks(spark, tmp_path):
    names = schema("fact_post_sentiment").names
    f = lambda *items: spark.createDataFrame([tuple(d.get(n) for n in names) for d in items], schema("fact_post_sentiment"))
    a = {"post_id": "p", "character_id": "x", "alias_matched": "X", "sentiment": "mixed", "created_at": datetime(2024, 1, 2)}
    each = I.merge_facts(str(tmp_path), "fact_post_sentiment", X.POST_KEY, lambda b: b)
    each(f(a, a | {"post_id": "q", "created_at": datetime(2024, 2, 2)}), 0)
    each(f(a | {"sentiment": "positive"}), 1)
    got = files.table(spark, str(tmp_path), "fact_post_sentiment")
    assert sorted((r.post_id, r.sentiment) for r in got.collect()) == [("p", "positive"), ("q", "mixed")]
    assert [r.post_id for r in I.changed_weeks(got, f(a)).collect()] == ["p"]


def test_marks(spark):
    marks = spark.createDataFrame([("a", "posts", 5)], "subreddit string, kind string, mark long")
    new = spark.createDataFrame([("a", "posts", 3), ("b", "posts", 9), ("a", "comments", 1)], "subreddit string, kind string, created_utc long")
    assert sorted(map(tuple, I.advance_marks(marks, new).collect())) == [("a", "comments", 1), ("a", "posts", 5), ("b", "posts", 9)]
    assert sorted(r.created_utc for r in I.above_marks(new, marks).collect()) == [1, 9]


def test_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": "x", "display_name": "X", "role": "r", "affiliation": "a", "status": "s", "aliases": [{"string": "X", "mode": "word_boundary", "weight": 0.5}], "notes": None}]))
    entities = files.dictionary(spark, str(tmp_path / "d.json"))
    r = files.dim_character(spark, entities).first()
    assert (r.character_id, r.alias_count, r.notes) == ("x", 1, "")
    (tmp_path / "e.json").write_text(json.dumps([{"id": "e1", "date": "2024-01-10", "title": "t", "verified": False}, {"id": "e2", "date": "2024-02-10", "title": "u", "verified": True, "chapter": 3}]))
    line = files.events(spark, str(tmp_path / "e.json"))
    assert [r.event_date for r in line.orderBy("pos").collect()] == [datetime(2024, 1, 10), datetime(2024, 2, 10)]
    items = spark.createDataFrame([(i, int(datetime(2024, m, d).timestamp())) for i, (m, d) in enumerate([(1, 4), (1, 18), (2, 5), (3, 1)])], "id int, created_utc long")
    assert sorted(r.id for r in files.in_windows(items, files.event_windows(line)).collect()) == [0, 2]
    assert sorted(r.id for r in files.in_windows(items, files.event_windows(line, verified_only=True)).collect()) == [2]
    (tmp_path / "cases.jsonl").write_text('{"id": "1", "category": "c", "text": "t", "expected": {"sentiment": "mixed", "intensity": "low", "target": "about_arc"}}\n\n')
    assert files.eval_cases(spark, str(tmp_path / "cases.jsonl")).first().expected_sentiment == "mixed"
    for n in range(2):  # a table may be made from itself
        old = files.table(spark, str(tmp_path), "agg_polarisation")
        files.replace_table(old.unionByName(empty(spark, "agg_polarisation")).unionByName(spark.createDataFrame([(f"c{n}", 1, 0.0, 0.0, 0.0, 1, 1)], schema("agg_polarisation"))), str(tmp_path), "agg_polarisation")
    assert files.table(spark, str(tmp_path), "agg_polarisation").count() == 2
    assert files.inventory(spark, str(tmp_path / "agg_polarisation")).first().files >= 1


def test_tables_are_replaced_in_one_step(spark, tmp_path):
    root = str(tmp_path)
    one = lambda n: spark.createDataFrame([(f"c{n}", n, 0.0, 0.0, 0.0, 1, 1)], schema("agg_polarisation"))
    assert files.current(spark, root, "agg_polarisation") is None
    files.replace_table(one(1), root, "agg_polarisation")
    first = files.table(spark, root, "agg_polarisation")
    files.replace_table(one(2), root, "agg_polarisation")
    assert [r.character_id for r in first.collect()] == ["c1"]  # a reader of the version before goes on
    # a writer that fails before its pointer is renamed changes nothing, and leaves what the next one clears
    one(9).write.parquet(f"{root}/agg_polarisation/v-left")
    (tmp_path / "agg_polarisation" / ".CURRENT-x").write_text("v-left")
    assert [r.character_id for r in files.table(spark, root, "agg_polarisation").collect()] == ["c2"]
    files.replace_table(one(3), root, "agg_polarisation")
    assert len(list((tmp_path / "agg_polarisation").glob("v-*"))) == 2
    assert [r.character_id for r in files.table(spark, root, "agg_polarisation").collect()] == ["c3"]


def test_cache_takes_the_last_line(spark, tmp_path):
    line = lambda key, label, at: json.dumps({"key": key, "result": {"sentiment": label, "confidence": 0.5, "intensity": "low", "target": "about_arc"}, "cached_at": at})
    one = tmp_path / "cache.jsonl"
    one.write_text("\n".join([line("a", "positive", "2024-02-02"), "not json", line("b", "mixed", "2024-01-01"), "", line("a", "negative", "2024-01-01"), '{"key": null}', '{"key": "c"}']) + "\n")
    got = lambda: {r.key: r.result.sentiment for r in files.cache(spark, str(one)).collect()}
    assert got() == {"a": "negative", "b": "mixed"}  # the later line, though its time is earlier
    # a file of several splits, each key many times
    many = [line(f"k{i % 7}", f"s{i}", "2024-01-01") for i in range(5_000)]
    one.write_text("\n".join(many))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert files.numbered_lines(spark, str(one)).rdd.getNumPartitions() > 3
        assert got() == {f"k{k}": f"s{max(i for i in range(5_000) if i % 7 == k)}" for k in range(7)}
        assert [r.line for r in files.numbered_lines(spark, str(one)).orderBy("place").collect()] == many
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_overlapping_windows_give_items_once(spark):
    import random

    rng = random.Random(8)
    windows = [(a, a + rng.choice([-5, 0, 1, 3_600, 86_400, 900_000])) for a in (rng.randint(-10**6, 10**6) for _ in range(60))] * 2
    items = [(i, rng.randint(-10**6, 10**6)) for i in range(800)] + [(900, None)] + [(1_000 + i, t) for i, (a, b) in enumerate(windows) for t in (a,)] + [(2_000 + i, b) for i, (a, b) in enumerate(windows)]
    got = files.in_windows(spark.createDataFrame(items, "id int, created_utc long"), spark.createDataFrame(windows, "after long, before long"), seconds=50_000)
    assert sorted(r.id for r in got.collect()) == sorted(i for i, t in items if t is not None and any(a <= t < b for a, b in windows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("salts", [1, 5])
def test_nearest_event_by_asof(spark, salts):
    import random

    from tidemark.operators import anomalies as A

    rng = random.Random(salts)
    start = datetime(2020, 1, 1)
    events = [(f"e{i}", f"t{i}", start + timedelta(rng.choice([rng.randint(0, 30), rng.randint(60, 200)])), pos) for i, pos in enumerate(rng.sample(range(100), 40))]
    rows = [(i, start + timedelta(rng.randint(-20, 240), rng.choice([0, rng.randint(1, 86_399)]))) for i in range(500)] + [(500, None)]
    line = spark.createDataFrame(events, "event_id string, title string, event_date timestamp, pos int")
    df = spark.createDataFrame(rows, "asof_id int, week_start timestamp")
    got = A.nearest_event_asof(df, line, salts=salts)
    want = A.nearest_event(df, line)
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert A.nearest_event_asof(df, line.limit(0)).where("paired_event_id is not null").count() == 0


@pytest.mark.parametrize("listed", [1_000_000, 0])
def test_asof_rows_are_not_sorted(spark, monkeypatch, listed):
    from tidemark.operators import anomalies as A

    monkeypatch.setattr(A, "LIST_ROWS", listed)
    line = spark.createDataFrame([(f"e{i}", f"t{i}", datetime(1960 + i, 3, 1), 9 - i) for i in range(9)] + [("same day", "", datetime(1960, 3, 1), 0), ("no day", "", None, 1)], "event_id string, title string, event_date timestamp, pos int")
    first = datetime(1960, 2, 20)
    df = spark.createDataFrame([(i, first + timedelta(i // 4, i % 4, 7 * (i % 2))) for i in range(100)] * 2 + [(500, None)] * 3, "`asof_a.b` int, week_start timestamp")
    got, want = A.nearest_event_asof(df, line, salts=3), A.nearest_event(df.withColumnRenamed("asof_a.b", "id"), line)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and ("Sort" not in plan or not listed)  # the memory of a task doesn't follow its rows


def test_nearest_of_many_events(spark):
    import bisect

    from tidemark.operators import anomalies as A

    day = lambda i: (i * 7919) % 36_500
    line = spark.range(100_000).selectExpr("concat('e', id) as event_id", "'t' as title", "timestamp_seconds(86400L * ((id * 7919) % 36500) * 3) as event_date", "cast(id as int) as pos")
    rows = spark.range(3_000).selectExpr("id", "timestamp_seconds(86400L * ((id * 131) % 109500)) as week_start")
    first = {}
    for i in range(100_000):
        first.setdefault(3 * day(i), i)
    days = sorted(first)
    got = {r.id: (r.paired_event_id, r.paired_event_distance_days) for r in A.nearest_event_asof(rows, line, days=1).collect()}
    for i in range(3_000):
        d = i * 131 % 109_500
        k = bisect.bisect_left(days, d - 1)
        near = [(abs(x - d), first[x]) for x in days[k : k + 3] if abs(x - d) <= 1]
        assert got[i] == ((f"e{min(near)[1]}", min(near)[0]) if near else (None, None))
