import json

import pytest

from tidemark.plans import cli
from tidemark.schemas import schema
from tidemark.sources import files


def stub():
    return lambda text: {"sentiment": "positive" if "good" in text else "negative", "confidence": 0.9, "intensity": "high", "target": "about_meta"}


def told():
    """A model that wants a chat, and answers by what it was told of the word in the text."""

    def call(messages):
        assert messages[0] == {"role": "system", "content": "rules"} and [m["role"] for m in messages[1:]] == ["user", "assistant", "user"]
        assert json.loads(messages[2]["content"])["sentiment"] == "mixed"
        return {"sentiment": "positive" if "good" in messages[-1]["content"] else "negative", "confidence": 0.9, "intensity": "high", "target": "about_meta"}

    return call


def summariser():
    return lambda d: ("yes", "no")


def test_from_archive_to_summaries(spark, tmp_path):
    d = {n: str(tmp_path / n) for n in ("bronze", "silver", "gold", "labels", "cache", "report")}
    for kind in ("posts", "comments"):
        (tmp_path / "archive" / kind).mkdir(parents=True)
    day = 86_400
    posts = [{"id": f"p{i}", "subreddit": "S", "author": "x", "created_utc": 1_700_000_000 + i * day, "title": f"Gold is {'good' if i % 2 else 'bad'} today", "selftext": "" if i % 3 else "a body of text", "score": i} for i in range(400)]
    comments = [{"id": f"c{i}", "subreddit": "S", "created_utc": 1_700_000_000 + i * day, "body": "Gold is good" if i % 5 else "[removed]", "link_id": "t3_p1", "score": "1"} for i in range(30)]
    (tmp_path / "archive" / "posts" / "a.json").write_text(json.dumps(posts))
    (tmp_path / "archive" / "comments" / "a.json").write_text(json.dumps(comments))
    (tmp_path / "dict.json").write_text(json.dumps([{"id": "gold", "display_name": "Gold", "aliases": [{"string": "Gold", "mode": "word_boundary", "weight": 1.0}]}]))
    (tmp_path / "events.json").write_text(json.dumps([{"id": "e", "date": "2023-12-01", "title": "t", "verified": True}]))
    run = lambda *args: cli.main([str(x) for x in args])
    place = ["--bronze", d["bronze"], "--communities", "a", "--path", tmp_path / "archive"]
    run("events", *place, "--events", tmp_path / "events.json")
    assert 0 < files.partitioned_bronze(spark, d["bronze"], "posts").count() <= 15
    run("backfill", *place, "--after", 0, "--before", 1 << 40)
    run("silver", "--bronze", d["bronze"], "--silver", d["silver"], "--salt", "s")
    assert files.table(spark, d["silver"], "silver_posts").count() == 400  # the overlap is gone
    run("classify", "--silver", d["silver"], "--labels", d["labels"], "--cache", d["cache"], "--model", "tests.test_cli:stub")
    labels = spark.read.parquet(d["labels"] + "/posts")
    assert labels.count() == 400 and {r.sentiment for r in labels.collect()} == {"positive", "negative"}
    assert files.cache(spark, d["cache"]).count() == 6  # distinct texts only
    (tmp_path / "prompt.json").write_text(json.dumps({"system": "rules", "examples": [["a case", {"sentiment": "mixed"}]]}))
    run("classify", "--silver", d["silver"], "--labels", d["labels"] + "2", "--cache", d["cache"] + "2", "--model", "tests.test_cli:told", "--prompt", tmp_path / "prompt.json")
    again = spark.read.parquet(d["labels"] + "2/posts")
    assert sorted((r.id, r.sentiment) for r in again.collect()) == sorted((r.id, r.sentiment) for r in labels.collect())
    build = ["--silver", d["silver"], "--gold", d["gold"]]
    run("gold", *build, "--labels", d["labels"], "--dictionary", tmp_path / "dict.json", "--events", tmp_path / "events.json")
    assert files.table(spark, d["gold"], "agg_polarisation").first().total_mentions == 400 + 24
    run("reason", *build, "--model", "tests.test_cli:summariser")
    assert files.table(spark, d["gold"], "char_summary").first().positive_summary == "yes"
    (tmp_path / "cases.jsonl").write_text(json.dumps({"id": "p1", "category": "c", "text": "t", "expected": {"sentiment": "positive", "intensity": "high", "target": "about_meta"}}))
    run("eval", "--cases", tmp_path / "cases.jsonl", "--predictions", d["labels"] + "/posts", "--out", d["report"])
    assert json.loads(spark.read.text(d["report"]).first()[0])["eval_set_size"] == 1
    run("sample", "--labels", d["labels"] + "/posts", "--n", 3)
    run("status", "--bronze", d["bronze"], "--silver", d["silver"], "--gold", d["gold"], "--cache", d["cache"])
    seen = {r.layer: r for r in files.status(spark, {"gold": d["gold"], "none": d["gold"] + "x"}, d["cache"]).collect()}
    assert set(seen) == {"gold", "cache"} and seen["gold"].files > 5 and seen["cache"].lines > 2 and seen["gold"].lines is None
    with pytest.raises(SystemExit):
        run("gold")
    assert schema("char_summary").names


def listing(children, after=None):
    return {"kind": "Listing", "data": {"children": [{"kind": k, "data": d} for k, d in children], "after": after}}


class Api:
    """Answers of a feed's API; calls are kept."""

    def __init__(self):
        self.calls, self.posts = [], [{"id": f"p{i}", "subreddit": "S", "author": None if i % 2 else "x", "created_utc": 1_700_000_000.0 + i, "title": f"t{i}", "permalink": f"/r/S/p{i}", "is_self": True} for i in range(130)]

    def answer(self, path, query):
        self.calls.append(path)
        if path == "/r/S/new":
            at = int(query.get("after", ["0"])[0])
            rows = sorted(self.posts, key=lambda r: -r["created_utc"])[at : at + int(query["limit"][0])]
            return listing([("t3", r) for r in rows], str(at + len(rows)) if at + len(rows) < len(self.posts) else None)
        if path == "/comments/p7":
            return None  # fails
        if path.startswith("/comments/"):
            post = path.rpartition("/")[2]
            comment = lambda i, replies="": ("t1", {"id": f"c{post}{i}", "subreddit": "S", "author": "y", "created_utc": 1_700_000_000, "body": "b", "link_id": f"t3_{post}", "replies": replies})
            tree = listing([comment(0, listing([comment(1), ("more", {"children": ["x", "y"]})])), ("more", {"children": []})])
            return [listing([]), tree if post in ("p1", "p129") else listing([])]
        if path == "/api/morechildren":
            return {"json": {"data": {"things": [{"kind": "t1", "data": {"id": f"{k}{query['link_id'][0]}", "subreddit": "S", "created_utc": 5, "body": "more", "link_id": query["link_id"][0]}} for k in query["children"][0].split(",")]}}}
        return None


def test_live_runs_into_bronze(spark, tmp_path, monkeypatch):
    import threading
    import urllib.parse
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from tidemark.sources import live

    api = Api()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urllib.parse.urlparse(self.path)
            body = api.answer(at.path, urllib.parse.parse_qs(at.query))
            self.send_response(200 if body is not None else 404)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = live.get_json({"url": f"http://127.0.0.1:{server.server_port}"}, lambda: None)
    assert [r["id"] for r in live.newest(get, "S")] == [f"p{i}" for i in range(129, -1, -1)] and api.calls.count("/r/S/new") == 2
    assert sorted(r["id"] for r in live.thread(get, "p1")) == ["cp10", "cp11", "xt3_p1", "yt3_p1"]
    assert sorted(r["id"] for r in live.thread(get, "p1", expanded=0)) == ["cp10", "cp11"]
    assert sum(p["id"] == "p3" for p in live.newest(get, "S", 127)) == 1 and len(live.newest(get, "S", 127)) == 127
    # from a folder, the driver: two runs, the second with what is new
    for kind in ("posts", "comments"):
        (tmp_path / "feed" / kind).mkdir(parents=True)
    feed = tmp_path / "feed" / "posts" / "S.json"
    feed.write_text(json.dumps(api.posts[:3]))
    (tmp_path / "feed" / "comments" / "S.json").write_text(json.dumps([{"id": f"c{i}", "subreddit": "S", "created_utc": 1, "body": "b", "link_id": f"t3_p{i}"} for i in range(5)]))
    args = ["live", "--bronze", str(tmp_path / "bronze"), "--communities", "S,none", "--path", str(tmp_path / "feed"), "--checkpoint", str(tmp_path / "cp")]
    count = lambda kind: files.partitioned_bronze(spark, str(tmp_path / "bronze"), kind).where("retrieved_at is not null and _source = 'live'").count()
    cli.main(args)
    assert (count("posts"), count("comments")) == (3, 3)
    feed.write_text(json.dumps(api.posts[:5]))
    cli.main(args)
    cli.main(args)
    assert (count("posts"), count("comments")) == (5, 5)
    posts = {r.id: r for r in files.partitioned_bronze(spark, str(tmp_path / "bronze"), "posts").collect()}
    assert posts["p1"].author == "[deleted]" and posts["p2"].author == "x" and posts["p2"].permalink == "/r/S/p2"
    # the same by HTTP, a thread that fails left out
    monkeypatch.setattr(live, "PER_SECOND", 1000.0)
    few = spark.createDataFrame([("p1", "S"), ("p129", "S"), ("p5", "S")], "id string, subreddit string")
    assert live.comments_of(few, {"url": f"http://127.0.0.1:{server.server_port}"}, tasks=1).count() == 8
    server.shutdown()
