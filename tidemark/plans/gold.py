"""The whole build: silver from bronze, gold from silver, and what the dashboard reads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import anomalies as A, facts as X, rankings as R, rollups as U, silver as S, summaries as Q
from ..operators.mentions import Entity
from ..schemas import conformed
from ..sources import files

LEAST_WEEKS = 50


class TooFewWeeks(RuntimeError):
    """The weekly table is too small to publish."""


@dataclass
class Gold:
    dim_character: DataFrame
    dim_event: DataFrame
    fact_post_sentiment: DataFrame
    fact_comment_sentiment: DataFrame
    agg_char_week: DataFrame
    agg_polarisation: DataFrame
    moments: DataFrame


def silver(spark: SparkSession, bronze_root: str, silver_root: str, salt: str) -> None:
    """Both silver tables, made anew from all of bronze."""
    files.replace_table(S.silver_posts(S.latest_bronze(files.bronze(spark, bronze_root, "posts")), salt), silver_root, "silver_posts")
    files.replace_table(S.silver_comments(S.latest_bronze(files.bronze(spark, bronze_root, "comments")), salt), silver_root, "silver_comments")


def frames(posts: DataFrame, comments: DataFrame, post_labels: DataFrame, comment_labels: DataFrame, entities: Sequence[Entity], timeline: DataFrame, old_posts: DataFrame | None = None, old_comments: DataFrame | None = None) -> Gold:
    """Gold as one lazy graph of frames; nothing runs here."""
    spark = posts.sparkSession
    new_posts, new_comments = X.post_facts(posts, post_labels, entities), X.comment_facts(comments, comment_labels, entities)
    post = X.upsert(old_posts, new_posts, X.POST_KEY) if old_posts is not None else new_posts
    comment = X.upsert(old_comments, new_comments, X.COMMENT_KEY) if old_comments is not None else new_comments
    weeks = conformed(U.weekly(X.all_facts(post, comment)), "agg_char_week")
    totals = conformed(R.ranked(U.all_time(weeks)), "agg_polarisation")
    moments = conformed(A.nearest_event(A.anomalies(weeks), timeline), "moments")
    return Gold(files.dim_character(spark, entities), conformed(timeline, "dim_event"), post, comment, weeks, totals, moments)


def build(spark: SparkSession, silver_root: str, gold_root: str, post_labels: DataFrame, comment_labels: DataFrame, entities: Sequence[Entity], timeline: DataFrame, least_weeks: int = LEAST_WEEKS) -> dict[str, int]:
    """The gold tables, published together once the weekly table is known to be large enough; rows of each.

    Facts are written first and read again, so the tables above them don't match mentions twice. Until all tables are
    written nobody sees any: a build that fails, at the check or anywhere else, leaves the set before as it was.
    """
    with files.publication(spark, gold_root) as p:
        g = frames(*[files.table(spark, silver_root, n) for n in ("silver_posts", "silver_comments")], post_labels, comment_labels, entities, timeline, p.table("fact_post_sentiment"), p.table("fact_comment_sentiment"))
        facts = [p.write(getattr(g, name), name) for name in ("fact_post_sentiment", "fact_comment_sentiment")]
        weeks = p.write(U.weekly(X.all_facts(*facts)), "agg_char_week")
        if (n := weeks.count()) < least_weeks:
            raise TooFewWeeks(f"{n} weekly rows, {least_weeks} are asked for")
        p.write(g.dim_character, "dim_character")
        p.write(g.dim_event, "dim_event")
        p.write(R.ranked(U.all_time(weeks)), "agg_polarisation")
        p.write(A.nearest_event(A.anomalies(weeks), timeline), "moments")
        return {name: p.table(name).count() for name in Gold.__dataclass_fields__}


def summaries(spark: SparkSession, silver_root: str, gold_root: str, summarise: Callable[[dict], tuple[str, str]], model: str = "", version: str = "v1") -> None:
    get = lambda n: files.table(spark, gold_root, n)
    heads = Q.headliners(get("agg_polarisation"), get("dim_character"))
    found = Q.camps(Q.quotes(get("fact_post_sentiment").join(heads.select("character_id"), "character_id", "left_semi"), files.table(spark, silver_root, "silver_posts")))
    files.replace_table(Q.summarised(heads, found, summarise, model, version), gold_root, "char_summary")
