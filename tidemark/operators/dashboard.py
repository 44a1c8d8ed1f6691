"""The queries of a dashboard over the gold tables. Every order has a full key, so results don't depend on chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D, metrics as M

TOP, MIN_VOLUME, LISTED = 6, 50, 10


def top(totals: DataFrame, n: int = TOP, entity: str = "character_id") -> DataFrame:
    return totals.orderBy(F.desc("total_mentions"), entity).limit(n)


def top_characters(totals: DataFrame, dim: DataFrame, n: int = TOP, entity: str = "character_id") -> DataFrame:
    named = totals.join(dim.select(entity, "display_name"), entity)
    return named.orderBy(F.desc("total_mentions"), entity).limit(n)


def headline_weekly(weeks: DataFrame, totals: DataFrame, dim: DataFrame, n: int = TOP, entity: str = "character_id") -> DataFrame:
    """The weeks of the n most mentioned (a semi join with at most n rows)."""
    few = F.broadcast(top(totals, n, entity).select(entity))
    return weeks.join(few, entity, "left_semi").join(dim.select(entity, "display_name"), entity).orderBy("week_start", entity, "year")


def events_timeline(events: DataFrame) -> DataFrame:
    return events.orderBy("event_date", "event_id")


def polarisation_ranking(totals: DataFrame, dim: DataFrame, n: int = LISTED, least: int = MIN_VOLUME, entity: str = "character_id") -> DataFrame:
    rows = totals.where(F.col("total_mentions") >= least).join(dim.select(entity, "display_name"), entity)
    return rows.orderBy(F.desc_nulls_last("polarisation_index"), entity).limit(n)


def latest_anomalies(moments: DataFrame, dim: DataFrame, n: int = LISTED, entity: str = "character_id") -> DataFrame:
    return moments.join(dim.select(entity, "display_name"), entity).orderBy(F.desc("week_start"), entity).limit(n)


def summaries(table: DataFrame) -> DataFrame:
    return table.orderBy("category")


def source_breakdown(facts: Sequence[DataFrame], totals: DataFrame, dim: DataFrame, n: int = TOP, entity: str = "character_id", source: str = "subreddit") -> DataFrame:
    """Mentions of the n most mentioned by source: counted before the names are joined."""
    rows = facts[0].select(entity, source)
    for f in facts[1:]:
        rows = rows.unionAll(f.select(entity, source))
    counted = rows.join(F.broadcast(top(totals, n, entity).select(entity)), entity).groupBy(entity, source).agg(F.count("*").alias("n"))
    return counted.join(dim.select(entity, "display_name"), entity).groupBy("display_name", source).agg(F.sum("n").alias("mention_count")).orderBy("display_name", source)


def total_mentions(top_rows: DataFrame) -> DataFrame:
    return top_rows.agg(F.coalesce(F.sum("total_mentions"), F.lit(0)).alias("total_mentions"))


def hero_stats(top_rows: DataFrame, entity: str = "character_id") -> DataFrame:
    """The warmest, coldest and most polarising of some rows; ties go to the first by mentions, then id."""
    index = F.coalesce(F.nanvl("polarisation_index", F.lit(-1.0)), F.lit(-1.0))
    first = [F.col("total_mentions"), F.col("rev")]
    rows = top_rows.withColumn("rev", -F.dense_rank().over(_by(entity)))
    return rows.agg(
        F.max_by(entity, F.struct("mean_sentiment_score", *first)).alias("warmest"),
        F.min_by(entity, F.struct("mean_sentiment_score", -F.col("total_mentions"), -F.col("rev"))).alias("coldest"),
        F.max_by(entity, F.struct(index, *first)).alias("most_polarising"),
    )


def _by(entity: str):
    from pyspark.sql import Window

    return Window.orderBy(entity)


def weekly_pivot(weeks: DataFrame, names: Sequence[str], label: Column | None = None, value: str = "mean_sentiment_score", name: str = "display_name") -> DataFrame:
    """A row for each week label and a column for each name; of weeks with one label the last by year and start counts."""
    rows = weeks.withColumn("week_label", D.week_label(F.col("week_start")) if label is None else label)
    return rows.groupBy("week_label").pivot(name, list(names)).agg(F.max_by(value, F.struct("year", "week_start"))).orderBy("week_label")


def source_pivot(breakdown: DataFrame, sources: Sequence[str], source: str = "subreddit", n: int | None = None) -> DataFrame:
    """A row for each name with its counts by source, by descending sum."""
    wide = breakdown.groupBy("display_name").pivot(source, list(sources)).agg(F.sum("mention_count")).na.fill(0, list(sources))
    total = sum((F.col(f"`{s}`") for s in sources), F.lit(0))
    wide = wide.withColumn("total", total).orderBy(F.desc("total"), "display_name")
    return wide.limit(n) if n else wide


def defined_only(rows: DataFrame, column: str = "polarisation_index") -> DataFrame:
    return rows.where(M.defined(F.col(column)))


def bubbles(rows: DataFrame) -> DataFrame:
    """x, y and size of the defined rows."""
    return defined_only(rows).select("display_name", F.col("mean_sentiment_score").alias("x"), F.col("polarisation_index").alias("y"), M.bubble_size(F.col("total_mentions")).alias("z"))


def cards(moments: DataFrame) -> DataFrame:
    return moments.select("*", M.headline(F.col("display_name"), F.col("z_score")).alias("headline"), D.date_line(F.col("week_start")).alias("date_line"))


def sample(rows: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows by a seeded digest of their key: the same ones wherever the rows lie, and in any engine."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
