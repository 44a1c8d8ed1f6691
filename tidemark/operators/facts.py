"""Facts: a row for each mention in a classified item, kept by upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import metrics as M, text as T
from ..schemas import conformed
from .mentions import Entity, with_mentions

POST_KEY, COMMENT_KEY = ["post_id", "character_id", "alias_matched"], ["comment_id", "character_id", "alias_matched"]


def classified(items: DataFrame, classifications: DataFrame, key: str = "id") -> DataFrame:
    """Items with their classification; those without one fall away."""
    labels = classifications.select(F.col(key), "sentiment", F.col("confidence").alias("sentiment_confidence"), "intensity", "target")
    return items.join(labels, key)


def _facts(items: DataFrame, classifications: DataFrame, text: Column, entities: Sequence[Entity]) -> DataFrame:
    rows = with_mentions(classified(items, classifications), text, entities)
    return rows.withColumn("sentiment_score", F.coalesce(M.sentiment_score(F.col("sentiment")), F.lit(0.0)))


def post_facts(posts: DataFrame, classifications: DataFrame, entities: Sequence[Entity]) -> DataFrame:
    rows = _facts(posts, classifications, T.resolver_text(F.col("title"), F.col("selftext")), entities)
    return conformed(rows.withColumnRenamed("id", "post_id"), "fact_post_sentiment")


def comment_facts(comments: DataFrame, classifications: DataFrame, entities: Sequence[Entity]) -> DataFrame:
    rows = _facts(comments, classifications, F.col("body"), entities).withColumn("post_id", T.without_prefix(F.col("link_id")))
    return conformed(rows.withColumnRenamed("id", "comment_id"), "fact_comment_sentiment")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], replace: Sequence[str] | None = None) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have.

    replace: a wider match (such as the item alone), by which all older rows of an item that came again go.
    """
    on = list(replace or key)
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)


def all_facts(posts: DataFrame | None, comments: DataFrame | None) -> DataFrame:
    """Both kinds in one, with `kind`; an absent table is left out."""
    columns = ["character_id", "sentiment", "sentiment_score", "sentiment_confidence", "intensity", "mention_weight", "created_at"]
    parts = [t.select(*columns, F.lit(kind).alias("kind")) for t, kind in ((posts, "post"), (comments, "comment")) if t is not None]
    if not parts:
        raise ValueError("no facts")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
