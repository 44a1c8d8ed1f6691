"""Commands: daily, live, backfill, events, silver, classify, eval, gold, reason, sample, status.

Models are given as `module:factory`, a function without arguments that gives the function to call; a prompt as a JSON file with
`system` and `examples`, with which a model gets a chat instead of the text alone.

    python -m tidemark.plans.cli silver --bronze b --silver s --salt x
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import classify as C, dashboard, evaluation, silver as S
from ..schemas import INTENSITIES, SENTIMENTS, TARGETS
from ..sources import files
from ..sources.archive import ArchiveSource
from ..sources.landing import land_comments, land_posts, landed_posts
from ..sources.live import credentials
from ..streaming.incremental import run_available
from . import gold

KINDS = ("posts", "comments")


def session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def loaded(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def backfill(spark: SparkSession, bronze: str, communities: str, after: int, before: int, **transport: str) -> dict[str, int]:
    """Posts and comments of [after, before) into bronze; the rows of each kind. Nothing is written for no rows."""
    spark.dataSource.register(ArchiveSource)
    counts = {}
    for kind, normalise in zip(KINDS, (S.archive_posts, S.archive_comments), strict=True):
        raw = spark.read.format("archive").options(kind=kind, communities=communities, after=after, before=before, **transport).load()
        rows = normalise(raw, datetime.now(UTC)).cache()
        counts[kind] = rows.count()
        if counts[kind]:
            files.append_bronze(rows, bronze, kind)
        rows.unpersist()
    return counts


def backfill_events(spark: SparkSession, bronze: str, communities: str, timeline: DataFrame, days: int = 7, verified_only: bool = False, **transport: str) -> dict[str, int]:
    """The windows around each event of a timeline, one after the other, as the archive asks for few calls."""
    total = dict.fromkeys(KINDS, 0)
    for w in files.event_windows(timeline, days, verified_only).collect():  # a timeline is a few rows
        for kind, n in backfill(spark, bronze, communities, w.after, w.before, **transport).items():
            total[kind] += n
    return total


def live(spark: SparkSession, bronze: str, communities: str, checkpoint: str, **transport: str) -> dict[str, int]:
    """Posts that are newer than the last run's, and their comments, into bronze; the rows of each kind.

    A run's posts are landed first, and so are a batch's comments. A run that fails later is done again from what has landed,
    so it has the same rows although the feed has moved on.
    """
    counts = dict.fromkeys(KINDS, 0)
    landing = f"{checkpoint}/landing"

    def each(batch: DataFrame, number: int) -> None:
        landed = {"posts": batch, "comments": land_comments(batch, landing, number, transport)}
        for kind, raw in landed.items():
            rows = S.live_rows(raw, kind)
            if n := rows.count():
                files.append_bronze(rows, bronze, kind)
            counts[kind] += n

    land_posts(spark, landing, communities, transport)
    run_available(landed_posts(spark, landing), f"{checkpoint}/stream", each)
    return counts


def build_silver(spark: SparkSession, bronze: str, silver: str, salt: str) -> None:
    files.replace_table(S.silver_posts(S.latest_bronze(files.partitioned_bronze(spark, bronze, "posts")), salt), silver, "silver_posts")
    files.replace_table(S.silver_comments(S.latest_bronze(files.partitioned_bronze(spark, bronze, "comments")), salt), silver, "silver_comments")


def prompt_of(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, dict]]] | None:
    """A prompt from a JSON file: `system`, and `examples`, a list of a text and its answer each; none without a path."""
    if not path:
        return None
    told = json.loads(files.read_text(spark, path))
    return told["system"], [(text, answer) for text, answer in told.get("examples", [])]


def classify(spark: SparkSession, silver: str, out: str, cache: str, model: Callable, version: str, model_name: str, **limits) -> None:
    """Both kinds of items to `<out>/<kind>`, and what was asked to the cache, so that no text is sent twice."""
    texts = {
        "posts": files.table(spark, silver, "silver_posts").select("id", T.classifier_text(*[F.col(c) for c in ("title_clean", "title", "selftext_clean", "selftext")]).alias("text")),
        "comments": files.table(spark, silver, "silver_comments").select("id", T.first_filled(F.col("body_clean"), F.col("body")).alias("text")),
    }
    for kind, rows in texts.items():
        # what was asked is kept first; the labels' plan still has the cache's files as they were
        labels, fresh = C.classify(rows.where(T.has_text(F.col("text"))), files.cache(spark, cache), model, version, model_name, **limits)
        files.append_cache(fresh, cache)
        labels.write.mode("overwrite").parquet(f"{out}/{kind}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    where = {"bronze": None, "communities": None, "path": "", "url": ""}
    build = {"silver": None, "gold": None, "labels": None, "dictionary": None, "events": None}
    model = {"cache": None, "model": None, "version": "v1", "name": "", "prompt": ""}
    for name, options in {
        "backfill": where | {"after": None, "before": None},
        "events": where | {"events": None, "days": "7", "verified": ""},
        "live": where | {"checkpoint": None, "credentials": ""},
        "daily": where | build | model | {"salt": None, "days": "2"},
        "silver": {"bronze": None, "silver": None, "salt": None},
        "classify": {"silver": None, "labels": None} | model,
        "eval": {"cases": None, "predictions": None, "out": None, "version": "v1", "name": ""},
        "gold": build,
        "reason": {"silver": None, "gold": None, "model": None, "version": "v1", "name": ""},
        "sample": {"labels": None, "n": "20", "seed": "0"},
        "status": {"bronze": "", "silver": "", "gold": "", "cache": ""},
    }.items():
        c = sub.add_parser(name)
        for o, default in options.items():
            c.add_argument(f"--{o}", required=default is None, default=default)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    transport = {k: getattr(a, k) for k in ("path", "url") if getattr(a, k, "")}
    if a.command in ("backfill", "daily"):
        now = int(datetime.now(UTC).timestamp())
        after, before = (int(a.after), int(a.before)) if a.command == "backfill" else (now - int(timedelta(days=int(a.days)).total_seconds()), now)
        print(backfill(spark, a.bronze, a.communities, after, before, **transport))
    if a.command == "live":
        if a.credentials:  # names of settings: a token, and who asks
            transport |= dict(zip(("token", "agent"), credentials(tuple(a.credentials.split(","))).values(), strict=False))
        print(live(spark, a.bronze, a.communities, a.checkpoint, **transport))
    if a.command == "events":
        print(backfill_events(spark, a.bronze, a.communities, files.events(spark, a.events), int(a.days), bool(a.verified), **transport))
    if a.command in ("silver", "daily"):
        build_silver(spark, a.bronze, a.silver, a.salt)
    if a.command in ("classify", "daily"):
        classify(spark, a.silver, a.labels, a.cache, loaded(a.model), a.version, a.name, prompt=prompt_of(spark, a.prompt))
    if a.command in ("gold", "daily"):
        labels = [spark.read.parquet(f"{a.labels}/{kind}") for kind in KINDS]
        for name, n in gold.build(spark, a.silver, a.gold, *labels, files.dictionary(spark, a.dictionary), files.events(spark, a.events)).items():
            print(name, n)
    if a.command == "eval":
        axes = {"sentiment": SENTIMENTS, "intensity": INTENSITIES, "target": TARGETS}
        files.write_report(evaluation.report(files.eval_cases(spark, a.cases), spark.read.parquet(a.predictions), axes, a.version, a.name), a.out)
    if a.command == "reason":
        gold.summaries(spark, a.silver, a.gold, loaded(a.model)(), a.name, a.version)
    if a.command == "sample":
        dashboard.sample(spark.read.parquet(a.labels), int(a.n), int(a.seed)).show(int(a.n), truncate=80)
    if a.command == "status":
        files.status(spark, {n: getattr(a, n) for n in ("bronze", "silver", "gold") if getattr(a, n)}, a.cache).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
