"""Weeks whose sentiment is far from an entity's trailing baseline, paired with the nearest event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import dates as D
from ..staging import free_prefix, staged

#: Rows before the current one, mentions of the current one, deviations, days to an event.
BASELINE_ROWS, MIN_MENTIONS, THRESHOLD, PAIR_DAYS = 12, 10, 2.0, 7


def anomalies(weeks: DataFrame, entity: str = "character_id", rows: int = BASELINE_ROWS, min_mentions: int = MIN_MENTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows, not calendar weeks, make the baseline; it must be full and vary, and |z| must exceed the threshold."""
    before = Window.partitionBy(entity).orderBy("week_start", "year").rowsBetween(-rows, -1)
    score = F.col("mean_sentiment_score")
    base = weeks.select(entity, "week_start", score.alias("sentiment_score"), F.avg(score).over(before).alias("baseline_mean"), F.stddev_pop(score).over(before).alias("baseline_std"), "mention_count", F.count("*").over(before).alias("__n"))
    base = base.where((F.col("mention_count") >= min_mentions) & (F.col("__n") == rows) & (F.col("baseline_std") > 0))
    z = (F.col("sentiment_score") - F.col("baseline_mean")) / F.col("baseline_std")
    return base.withColumn("z_score", z).where(F.abs("z_score") > threshold).select(entity, "week_start", "sentiment_score", "baseline_mean", "baseline_std", "z_score", "mention_count")


def nearest_event(rows: DataFrame, events: DataFrame, at: str = "week_start", days: int = PAIR_DAYS) -> DataFrame:
    """rows with the nearest event within so many days, or nulls; of equally near ones the first in the timeline.

    events: event_id, title, event_date, pos. A timeline is written by hand, so it is collected into each row's
    expression as one broadcast array: no range join, and a row never multiplies.
    """
    line = events.agg(F.sort_array(F.collect_list(F.struct("pos", "event_id", "title", F.col("event_date").cast("timestamp").alias("date")))).alias("__events"))
    with_line = rows.join(F.broadcast(line))
    near = F.transform("__events", lambda e: F.struct(D.whole_days_between(e["date"], F.col(at).cast("timestamp")).alias("d"), e["pos"].alias("pos"), e["event_id"].alias("id"), e["title"].alias("title")))
    best = F.array_min(F.filter(near, lambda e: e["d"] <= days))
    out = with_line.withColumn("__best", best)
    return out.select(*rows.columns, F.col("__best.id").alias("paired_event_id"), F.col("__best.title").alias("paired_event_title"), F.col("__best.d").alias("paired_event_distance_days"))


#: Parts that a day is dealt to in an as-of join whose list is too long to be broadcast, so that a hot day is not one task's.
SALTS = 16
#: Rows and bytes, about, of a list of days that is broadcast at most.
LIST_ROWS, LIST_BYTES = 1_000_000, 64 << 20


def nearest_event_asof(rows: DataFrame, events: DataFrame, at: str = "week_start", days: int = PAIR_DAYS, salts: int = SALTS) -> DataFrame:
    """`nearest_event` for timelines of any length, whose events are at midnight.

    Whole days between a row and a midnight only depend on the first midnight at or after the row. So each event day, with the
    first of its events in the timeline, is listed for the midnights that it can pair with, the nearest is kept for each, and rows meet that list
    by equality: it has a row for each midnight at most, however many rows and events there are. It is broadcast, so rows are neither
    sorted nor shuffled; only a list beyond LIST_ROWS or LIST_BYTES is met in a shuffle, with each midnight dealt to `salts` parts.
    Rows without a time pair with nothing.
    """
    p = free_prefix(rows, "asof_")
    day = F.lit(86_400_000_000)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    day_of = lambda t: ((t - F.pmod(t, day)) / day).cast("long")  # noqa: E731  an exact quotient
    daily = events.select(day_of(micros("event_date")).alias("day"), F.struct("pos", "event_id", "title").alias("e")).where("day is not null").groupBy("day").agg(F.min("e").alias("e"))
    near = daily.select(F.explode(F.sequence(F.col("day") - days, F.col("day") + days)).alias(f"{p}midnight"), "day", "e")
    best = F.min(F.struct(F.abs(F.col("day") - F.col(f"{p}midnight")).cast("int").alias("d"), F.col("e.pos").alias("pos"), F.col("e.event_id").alias("id"), F.col("e.title").alias("title")))
    near = staged(near.groupBy(f"{p}midnight").agg(best.alias(f"{p}best")), "asof-days")
    width = F.coalesce(F.octet_length(f"{p}best.id"), F.lit(0)) + F.coalesce(F.octet_length(f"{p}best.title"), F.lit(0)) + 64
    n, size = near.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    here = rows.withColumn(f"{p}midnight", day_of(micros(at)) + (F.pmod(micros(at), day) > 0).cast("long"))
    key = [f"{p}midnight"]
    if n <= LIST_ROWS and size <= LIST_BYTES:
        near = F.broadcast(near)
    else:
        here = here.withColumn(f"{p}salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int"))
        near, key = near.withColumn(f"{p}salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*key, f"{p}salt"]
    got = here.join(near, key, "left")
    return got.select(*[F.col(f"`{c}`") for c in rows.columns], F.col(f"{p}best.id").alias("paired_event_id"), F.col(f"{p}best.title").alias("paired_event_title"), F.col(f"{p}best.d").alias("paired_event_distance_days"))
