"""Date functions. Sessions are taken to be in UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def calendar_year(ts: Column) -> Column:
    """The calendar's year, not the ISO week's: a week over New Year has two."""
    return F.year(ts)


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts)


def week_label(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.year(ts), F.weekofyear(ts))


def date_line(ts: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(ts, "yyyy.MM.dd"), F.lit(" · "), F.upper(F.date_format(ts, "EEE"))), F.lit("Undated"))


def whole_days_between(a: Column, b: Column) -> Column:
    """abs(floor(a - b in days)), as a difference of timestamps counts days."""
    return F.abs(F.floor((F.unix_micros(a) - F.unix_micros(b)) / F.lit(86_400_000_000))).cast("int")


def midnight(d: Column) -> Column:
    return F.to_timestamp(d)


def human_age(then: Column, now: Column) -> Column:
    s = F.floor((F.unix_micros(now) - F.unix_micros(then)) / F.lit(1_000_000))
    m, h = F.floor(s / 60), F.floor(s / 3600)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(m < 60, text(m, "m")).when(h < 48, text(h, "h")).otherwise(text(F.floor(h / 24), "d"))
