"""Live runs that fail and are done again, and the archive in slices."""

import json
import random
from datetime import datetime

import pytest

from tidemark.operators import silver as S
from tidemark.sources import archive, files, landing
from tidemark.streaming.incremental import run_available


class Lost(RuntimeError):
    pass


def post(i, at, community="a"):
    return {"id": f"{community}{i}", "subreddit": community, "created_utc": at, "title": f"t{i}"}


def feed(tmp_path, community, rows):
    (tmp_path / "feed/posts").mkdir(parents=True, exist_ok=True)
    (tmp_path / f"feed/posts/{community}.json").write_text(json.dumps(rows))


def test_a_batch_that_fails_gets_the_same_rows(spark, tmp_path):
    root, options, got = str(tmp_path / "landing"), {"path": str(tmp_path / "feed")}, []
    feed(tmp_path, "a", [post(i, i + 1) for i in range(5)])
    feed(tmp_path, "b", [post(i, i + 100, "b") for i in range(2)])

    def each(batch, number):
        rows = sorted(r.id for r in batch.collect())
        if not got and rows:
            got.append(("lost", rows))
            raise Lost()
        got.append((number, rows))

    assert landing.land_posts(spark, root, "a, b,none", options) == 0
    with pytest.raises(Exception, match="Lost"):
        run_available(landing.landed_posts(spark, root), str(tmp_path / "cp"), each)
    # the feed moves on: old posts are gone, there are new ones
    feed(tmp_path, "a", [post(i, i + 1) for i in range(4, 8)])
    feed(tmp_path, "b", [])
    run_available(landing.landed_posts(spark, root), str(tmp_path / "cp"), each)
    assert got[1] == (0, got[0][1]) and got[0][1] == ["a0", "a1", "a2", "a3", "a4", "b0", "b1"]
    assert landing.land_posts(spark, root, "a,b", options) == 1
    run_available(landing.landed_posts(spark, root), str(tmp_path / "cp"), each)
    assert got[2:] == [(1, ["a5", "a6", "a7"])]
    assert sorted(map(tuple, landing.marks(spark, root).collect())) == [("a", 8), ("b", 101)]


def test_a_run_that_fails_before_it_is_complete_is_asked_for_anew(spark, tmp_path):
    root, options = str(tmp_path / "landing"), {"path": str(tmp_path / "feed")}
    feed(tmp_path, "a", [post(1, 10)])
    landing.land_posts(spark, root, "a", options)
    # the run landed, its marks didn't
    (tmp_path / "landing/marks/run=0/_SUCCESS").unlink()
    assert [tuple(r) for r in landing.marks(spark, root).collect()] == [("a", 10)]
    feed(tmp_path, "a", [post(1, 10), post(2, 10), post(3, 12)])
    landing.land_posts(spark, root, "a", options)
    (tmp_path / "landing/posts/run=1/_SUCCESS").unlink()
    feed(tmp_path, "a", [post(3, 12), post(4, 13)])
    assert landing.runs(spark, f"{root}/posts") == [0]
    assert landing.land_posts(spark, root, "a", options) == 1
    assert sorted(r.id for r in spark.read.parquet(f"{root}/posts/run=1").collect()) == ["a3", "a4"]


def test_comments_are_asked_for_once(spark, tmp_path):
    (tmp_path / "feed/comments").mkdir(parents=True)
    name, posts = tmp_path / "feed/comments/a.json", spark.createDataFrame([("a1", "a")], "id string, subreddit string")
    comment = lambda i: {"id": f"c{i}", "subreddit": "a", "created_utc": i, "body": "b", "link_id": "t3_a1"}
    name.write_text(json.dumps([comment(1)]))
    land = lambda n: sorted(r.id for r in landing.land_comments(posts, str(tmp_path / "landing"), n, {"path": str(tmp_path / "feed")}).collect())
    assert land(0) == ["c1"]
    name.write_text(json.dumps([comment(1), comment(2)]))
    assert land(0) == ["c1"] and land(1) == ["c1", "c2"]


@pytest.mark.parametrize(("after", "before", "seconds"), [(0, 10, 3), (5, 5, 3), (5, 6, 3), (3, 9, 3), (4, 100, 1_000), (-7, 7, 5), (0, 9, 0)])
def test_slices_cover_time_once(after, before, seconds):
    slices = archive.cut(after, before, seconds)
    assert [t for a, b in slices for t in range(a, b)] == list(range(after, before))
    assert all(a < b for a, b in slices)


def test_slices_have_the_rows_of_one_cursor(spark, tmp_path):
    rng = random.Random(6)
    (tmp_path / "posts").mkdir()
    for c in "ab":
        rows = [{"id": f"{c}{i}", "subreddit": c, "created_utc": rng.randint(0, 300)} for i in range(150)]
        (tmp_path / f"posts/{c}.json").write_text(json.dumps(rows))
    spark.dataSource.register(archive.ArchiveSource)
    read = lambda **o: spark.read.format("archive").options(kind="posts", communities="a,b", path=str(tmp_path), after=20, before=280, page=9, **o).load()
    one, many = read(overlap="true"), read(sliceSeconds=37)
    assert many.rdd.getNumPartitions() == 2 * len(archive.cut(20, 280, 37)) > one.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect())) and many.count() == len({r.id for r in one.collect()})


def test_archive_stream_goes_on_and_repeats(spark, tmp_path):
    (tmp_path / "posts").mkdir()
    rows = [{"id": f"x{i}", "subreddit": "a", "created_utc": i} for i in range(100)]
    (tmp_path / "posts/a.json").write_text(json.dumps(rows))
    spark.dataSource.register(archive.ArchiveSource)
    got = []

    def each(batch, number):
        ids = [r.id for r in S.archive_posts(batch, datetime(2024, 1, 1)).collect()]
        got.append(sorted(int(i[1:]) for i in ids))
        if len(got) == 1:
            raise Lost()

    def run(before):
        s = spark.readStream.format("archive").options(kind="posts", communities="a", path=str(tmp_path), after=5, before=before, sliceSeconds=10).load()
        run_available(s, str(tmp_path / "cp"), each)

    with pytest.raises(Exception, match="Lost"):
        run(40)
    run(40)
    run(70)
    assert got[:2] == [list(range(5, 40))] * 2
    assert [x for part in got[1:] for x in part] == list(range(5, 70))
    assert files.exists(spark, str(tmp_path))
