"""An archive of posts and comments as a data source: paged by an ascending cursor, one partition for each community
or, with sliceSeconds, for each slice of its time, so that a large community is not one task's. A slice asks with overlap (unless it
is switched off), as each slice would else lose rows at its own cut seconds; then the slices' rows are those of one cursor.
The transport is pluggable: HTTP, or a folder of JSON pages for use without a network.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").option("kind", "posts").option("communities", "a,b").option("after", 0).option("before", 9) ...
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.classify import paced, with_retries
from ..schemas import ddl

#: Calls a second, pages of a call, attempts, first and longest wait.
PER_SECOND, MAX_PAGES, ATTEMPTS, WAITS = 0.5, 200, 4, (2.0, 30.0)
FIELDS = {kind: tuple(f.split()[0] for f in ddl(f"archive_{kind}").split(", ")) for kind in ("posts", "comments")}


def seconds(row: dict) -> int:
    return int(row.get("created_utc") or 0)


def pages(fetch: Callable[[int], list[dict]], after: int, max_pages: int = MAX_PAGES, overlap: bool = False) -> Iterator[dict]:
    """Rows of ascending pages, each id once.

    The next cursor is the last second plus one, so rows of that second beyond a cut page are lost; with overlap it is
    the last second itself, which finds them. It ends with an empty page, one without a new id, a cursor that stands
    still, or after max_pages.
    """
    seen: set[str] = set()
    cursor = after
    for _ in range(max_pages):
        rows = fetch(cursor)
        if not rows:
            return
        new = [r for r in rows if r.get("id") and r["id"] not in seen and not seen.add(r["id"])]
        yield from new
        last = max(map(seconds, rows))
        following = last if overlap else last + 1
        if not new or (last <= cursor and not overlap) or following < cursor:
            return
        cursor = following


def folder_transport(path: str, kind: str, community: str, before: int, page: int = 100) -> Callable[[int], list[dict]]:
    """Pages from `<path>/<kind>/<community>.json`, a list of payloads."""
    name = os.path.join(path, kind, f"{community}.json")
    rows = json.load(open(name, encoding="utf-8")) if os.path.exists(name) else []
    rows.sort(key=seconds)
    return lambda cursor: [r for r in rows if cursor <= seconds(r) < before][:page]


def http_transport(url: str, kind: str, community: str, before: int, wait: Callable[[], None]) -> Callable[[int], list[dict]]:
    def fetch(cursor: int) -> list[dict]:
        query = {"subreddit": community, "after": cursor, "before": before, "sort": "asc", "limit": "auto", "fields": ",".join(FIELDS[kind])}

        def once():
            wait()
            with urllib.request.urlopen(f"{url}/{kind}/search?{urllib.parse.urlencode(query)}", timeout=30) as r:
                return json.load(r).get("data") or []

        return with_retries(once, ATTEMPTS, *WAITS)

    return fetch


def coerced(row: dict, kind: str) -> tuple:
    """Numbers may come as strings; the schema has them as strings, and a normaliser casts."""
    flags = ("over_18", "spoiler")
    return tuple(bool(row.get(f)) if f in flags else None if row.get(f) is None else str(row[f]) for f in FIELDS[kind])


class ArchivePartition(InputPartition):
    """A community's rows of [after, before), and how many partitions share the archive's rate."""

    def __init__(self, community: str, after: int, before: int, sharing: int):
        self.community, self.after, self.before, self.sharing = community, after, before, sharing


def cut(after: int, before: int, seconds: int) -> list[tuple[int, int]]:
    """[after, before) in slices that start at multiples of seconds (but for the first); whole if seconds is 0."""
    if after >= before:
        return []
    inner = range(-(-(after + 1) // seconds) * seconds, before, seconds) if seconds else []
    edges = [after, *inner, before]
    return list(zip(edges, edges[1:], strict=False))


def planned(options: dict, after: int, before: int) -> list[ArchivePartition]:
    communities = [c.strip() for c in options["communities"].split(",") if c.strip()]
    slices = cut(after, before, int(options.get("sliceseconds", 0)))
    return [ArchivePartition(c, a, b, len(communities) * len(slices)) for c in communities for a, b in slices]


def read_partition(options: dict, p: ArchivePartition) -> Iterator[tuple]:
    kind = options.get("kind", "posts")
    if "path" in options:
        fetch = folder_transport(options["path"], kind, p.community, p.before, int(options.get("page", 100)))
    else:
        fetch = http_transport(options["url"], kind, p.community, p.before, paced(PER_SECOND / p.sharing))
    sliced = "true" if int(options.get("sliceseconds", 0)) else "false"
    for row in pages(fetch, p.after, int(options.get("maxpages", MAX_PAGES)), str(options.get("overlap", sliced)).lower() == "true"):
        yield coerced(row, kind)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        before = int(self.options.get("before", 1 << 62))
        if int(self.options.get("sliceseconds", 0)) and "before" not in self.options:
            before = int(time.time()) + 1
        return planned(self.options, int(self.options.get("after", 0)), before)

    def read(self, partition):
        return read_partition(self.options, partition)


class ArchiveStreamReader(DataSourceStreamReader):
    """The archive as it grows: a batch has the rows since the last one's end, in slices. The offset is a time, and what is older
    doesn't change, so a batch that is run again asks for the same rows and gets them."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"until": int(self.options.get("after", 0))}

    def latestOffset(self) -> dict:
        """Now, less `lag` seconds that the archive may be behind; `before` at most."""
        return {"until": min(int(time.time()) - int(self.options.get("lag", 0)), int(self.options.get("before", 1 << 62)))}

    def partitions(self, start: dict, end: dict):
        return planned(self.options, int(start["until"]), int(end["until"]))

    def read(self, partition):
        return read_partition(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


def _lowered(options: dict) -> dict[str, str]:
    """Options by their names in lower case, as Spark doesn't tell cases apart."""
    return {k.lower(): v for k, v in options.items()}


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return ddl(f"archive_{self.options.get('kind', 'posts')}")

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(_lowered(self.options))

    def streamReader(self, schema) -> ArchiveStreamReader:
        return ArchiveStreamReader(_lowered(self.options))
