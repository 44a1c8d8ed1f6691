"""A live feed as a stream source. Its offset is the ingest high-water mark (epoch seconds) of each community; Spark's
checkpoint keeps it, so a run takes up where the last one ended.

    spark.dataSource.register(LiveSource)
    spark.readStream.format("live_feed").option("communities", "a,b").option("path", folder).load()

The transport is a folder of JSON (`path`), or an HTTP API with JSON listings (`url`, and `token`, `agent` if it wants them).
A batch has the NEWEST posts of each community at most, which the source asks for on the driver; the comments of a batch's
posts are asked for by tasks (`comments_of`).
"""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators.classify import paced, with_retries
from ..schemas import ddl
from ..shipping import ship
from .archive import ATTEMPTS, WAITS, seconds

#: Posts of a community in a run, rows of a listing, calls a second, and stubs of a thread that are expanded.
NEWEST, PAGE, PER_SECOND, EXPANDED = 500, 100, 1.0, 16


def credentials(names: tuple[str, ...], environ: dict[str, str] | None = None) -> dict[str, str]:
    """The named settings; all that are missing are told at once."""
    env = os.environ if environ is None else environ
    missing = [n for n in names if not env.get(n)]
    if missing:
        raise RuntimeError(f"not set: {', '.join(missing)}")
    return {n: env[n] for n in names}


def newer(feed: list[dict], mark: int, limit: int = NEWEST) -> tuple[list[dict], int]:
    """Of the newest rows those above the mark, and the new mark, which never falls."""
    rows = [r for r in sorted(feed, key=seconds, reverse=True)[:limit] if seconds(r) > mark]
    return rows, max([mark, *map(seconds, rows)])


def get_json(options: dict, wait: Callable[[], None]) -> Callable[..., object]:
    """A function of a path and query that asks the API, at its pace, and again after failures."""
    headers = {"User-Agent": options.get("agent", "tidemark")} | ({"Authorization": f"bearer {options['token']}"} if options.get("token") else {})

    def get(path: str, **query) -> object:
        def once():
            wait()
            with urllib.request.urlopen(urllib.request.Request(f"{options['url']}/{path}?{urllib.parse.urlencode(query)}", headers=headers), timeout=30) as r:
                return json.load(r)

        return with_retries(once, ATTEMPTS, *WAITS)

    return get


def newest(get: Callable[..., object], community: str, limit: int = NEWEST) -> list[dict]:
    """The newest posts, through as many listings as it takes."""
    rows: list[dict] = []
    after = None
    while len(rows) < limit:
        page = get(f"r/{urllib.parse.quote(community)}/new", limit=min(PAGE, limit - len(rows)), **({"after": after} if after else {}))["data"]
        rows += [c["data"] for c in page.get("children") or []]
        if not (after := page.get("after")):
            break
    return rows


def thread(get: Callable[..., object], post: str, expanded: int = EXPANDED) -> list[dict]:
    """All comments below a post, of whose stubs for further ones the first `expanded` are asked for."""
    found, todo, left = [], list(get(f"comments/{post}", limit=500)[1]["data"]["children"]), expanded
    while todo:
        item = todo.pop(0)
        data = item["data"]
        if item.get("kind") == "more":
            if left and data.get("children"):
                left -= 1
                more = get("api/morechildren", api_type="json", link_id=f"t3_{post}", children=",".join(data["children"]))
                todo += more["json"]["data"]["things"]
            continue
        found.append(data)
        todo += ((data.get("replies") or {}).get("data") or {}).get("children") or []
    return found


def from_folder(path: str, kind: str, community: str) -> list[dict]:
    try:
        with open(os.path.join(path, kind, f"{community}.json"), encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return []


def comments_of(posts: DataFrame, options: dict, tasks: int = 4) -> DataFrame:
    """Raw rows of the comments of posts (id, subreddit); a thread that can't be had is left out."""
    ship(posts.sparkSession)
    fields = [f.split()[0] for f in ddl("bronze_comments").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = get_json(options, paced(PER_SECOND / tasks)) if options.get("url") else None
        for batch in batches:
            rows = []
            for post, community in zip(batch["id"], batch["subreddit"], strict=True):
                try:
                    found = thread(get, post) if get else [r for r in from_folder(options["path"], "comments", community) if r.get("link_id") == f"t3_{post}"]
                except Exception:  # noqa: BLE001
                    continue
                rows += [tuple(seconds(r) if f == "created_utc" else None if f in ("retrieved_at", "_source") else r.get(f) for f in fields) for r in found]
            yield pd.DataFrame(rows, columns=fields)

    return posts.select("id", "subreddit").repartition(tasks, "id").mapInPandas(run, ddl("bronze_comments"))


class LiveReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.kind = options.get("kind", "posts")
        self.fields = [f.split()[0] for f in ddl(f"bronze_{self.kind}").split(", ")]

    def _feed(self, community: str) -> list[dict]:
        o = self.options
        try:
            return newest(get_json(o, paced(PER_SECOND)), community) if o.get("url") else from_folder(o["path"], self.kind, community)
        except (OSError, ValueError, KeyError):  # a feed that fails doesn't stop the others
            return []

    def _communities(self) -> list[str]:
        return [c.strip() for c in self.options["communities"].split(",") if c.strip()]

    def initialOffset(self):
        return dict.fromkeys(self._communities(), 0)

    def _rows(self, start: dict, end: dict | None):
        out, marks = [], dict(start)
        for c in self._communities():
            rows, mark = newer(self._feed(c), int(start.get(c, 0)))
            if end is not None:
                rows, mark = [r for r in rows if seconds(r) <= int(end.get(c, 0))], int(end.get(c, 0))
            marks[c] = mark
            out += [tuple(seconds(r) if f == "created_utc" else r.get(f) if f != "retrieved_at" else None for f in self.fields) for r in rows]
        return out, marks

    def read(self, start):
        rows, marks = self._rows(start, None)
        return iter(rows), marks

    def readBetweenOffsets(self, start, end):
        return iter(self._rows(start, end)[0])

    def commit(self, end):
        pass


class LiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_feed"

    def schema(self) -> str:
        return ddl(f"bronze_{self.options.get('kind', 'posts')}")

    def simpleStreamReader(self, schema) -> LiveReader:
        return LiveReader(dict(self.options))
