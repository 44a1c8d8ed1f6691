"""Unique ranks of all entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .numbering import numbered


def _orders(entity: str) -> tuple[list[Column], list[Column]]:
    """By polarisation, undefined ones last, and by mentions; ties go to more mentions, then to the id."""
    index = F.coalesce(F.nanvl("polarisation_index", F.lit(-1.0)), F.lit(-1.0))
    rest = [F.desc("total_mentions"), F.asc(entity)]
    return [index.desc(), *rest], rest


def ranked(totals: DataFrame, entity: str = "character_id") -> DataFrame:
    """polarisation_rank and most_mentioned_rank of entities from a dictionary: a row for each, so one task can order them."""
    by_index, by_mentions = _orders(entity)
    return totals.withColumns({"polarisation_rank": F.row_number().over(Window.orderBy(*by_index)), "most_mentioned_rank": F.row_number().over(Window.orderBy(*by_mentions))})


def ranked_many(totals: DataFrame, entity: str = "character_id") -> DataFrame:
    """The same for any number of entities: global row numbers over sorted ranges, so no task orders all of them."""
    by_index, by_mentions = _orders(entity)
    out = numbered(numbered(totals, by_index, "polarisation_rank"), by_mentions, "most_mentioned_rank")
    return out.withColumns({c: F.col(c).cast("int") for c in ("polarisation_rank", "most_mentioned_rank")})
