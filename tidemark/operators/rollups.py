"""Weekly and all-time rollups of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D, metrics as M

_CLASSES = ("positive", "negative", "mixed", "neutral")


def _count(condition: Column) -> Column:
    return F.count_if(condition)


#: Sums that can be added up: a row for each entity and week. Measures are decimals, so adding is exact;
#: 20 places hold all 17 digits of a double from 0.001 on: with fewer, a mean beside a tie would be rounded to the other side.
_EXACT = "decimal(38,20)"
STATE = "character_id string, year int, week int, week_start timestamp, mention_count long, post_count long, comment_count long, n_positive long, n_negative long, n_mixed long, n_neutral long, n_high long, score " + _EXACT + ", total " + _EXACT
_KEYS = ("year", "week", "week_start")


def sums(facts: DataFrame, entity: str = "character_id", at: str = "created_at", exact: bool = False, sign: int = 1) -> DataFrame:
    """Counts and weighted sums for each entity, calendar year and ISO week: one hash aggregate with map-side partial sums.

    exact: measures as decimals; sign: -1 for what is to be taken away.
    """
    w, ts = F.col("mention_weight") * F.col("sentiment_confidence"), F.col(at)
    kind = _EXACT if exact else "double"
    rows = facts.select(entity, D.calendar_year(ts).alias("year"), D.iso_week(ts).alias("week"), D.week_start(ts).cast("timestamp").alias("week_start"), "sentiment", "intensity", "kind", w.cast(kind).alias("w"), (F.col("sentiment_score") * w).cast(kind).alias("sw"))
    counts = {
        "mention_count": F.count("*"), "post_count": _count(F.col("kind") == "post"), "comment_count": _count(F.col("kind") == "comment"),
        **{f"n_{c}": _count(F.col("sentiment") == c) for c in _CLASSES}, "n_high": _count(F.col("intensity") == "high"), "score": F.sum("sw"), "total": F.sum("w"),
    }
    return rows.groupBy(entity, *_KEYS).agg(*[(c if sign == 1 else -c).alias(n) for n, c in counts.items()])


def added(states: DataFrame, entity: str = "character_id") -> DataFrame:
    """States added up by entity and week."""
    measures = [c for c in states.columns if c not in (entity, *_KEYS)]
    return states.groupBy(entity, *_KEYS).agg(*[F.sum(c).cast(states.schema[c].dataType).alias(c) for c in measures])


def finished(state: DataFrame, entity: str = "character_id") -> DataFrame:
    """The weekly table of `sums`."""
    shares = [F.col(f"n_{c}") / F.col("mention_count") for c in _CLASSES]
    score, total = F.col("score").cast("double"), F.col("total").cast("double")
    return state.select(
        entity, "year", "week", "week_start", "mention_count", "post_count", "comment_count",
        F.coalesce(total, F.lit(0.0)).alias("weighted_sentiment"), F.coalesce(F.try_divide(score, total), F.lit(0.0)).alias("mean_sentiment_score"),
        *[s.alias(f"share_{c}") for s, c in zip(shares, _CLASSES, strict=True)], (F.col("n_high") / F.col("mention_count")).alias("share_high_intensity"),
        M.polarisation_index(F.col("n_positive"), F.col("n_negative")).alias("polarisation_index"), M.normalised_entropy(shares).alias("polarisation_entropy"),
    )


def weekly(facts: DataFrame, entity: str = "character_id", at: str = "created_at") -> DataFrame:
    """A row for each entity, calendar year and ISO week."""
    return finished(sums(facts, entity, at), entity)


def all_time(weeks: DataFrame, entity: str = "character_id") -> DataFrame:
    """Sums over the weeks; counts are rebuilt from shares, and the mean is weighted by mentions."""
    n = F.col("mention_count")
    sums = weeks.groupBy(entity).agg(
        F.sum(n).alias("total_mentions"),
        F.try_divide(F.sum(F.col("mean_sentiment_score") * n), F.sum(n)).alias("mean"),
        *[F.sum(F.col(f"share_{c}") * n).alias(f"n_{c}") for c in _CLASSES],
    )
    shares = [F.coalesce(F.try_divide(F.col(f"n_{c}"), F.col("total_mentions")), F.lit(0.0)) for c in _CLASSES]
    return sums.select(
        entity, "total_mentions", F.coalesce("mean", F.lit(0.0)).alias("mean_sentiment_score"),
        M.polarisation_index(F.col("n_positive"), F.col("n_negative")).alias("polarisation_index"), M.normalised_entropy(shares).alias("polarisation_entropy"),
    )
