"""Measures as column expressions. Undefined measures are NaN, as in the stored tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

NAN = float("nan")


def sentiment_score(sentiment: Column) -> Column:
    return F.when(sentiment == "positive", 1.0).when(sentiment == "negative", -1.0).when(sentiment.isin("mixed", "neutral"), 0.0)


def intensity_number(intensity: Column) -> Column:
    return F.when(intensity == "low", 1).when(intensity == "medium", 2).when(intensity == "high", 3)


def polarisation_index(positive: Column, negative: Column) -> Column:
    return F.coalesce(1.0 - 2.0 * F.abs(F.try_divide(positive, positive + negative) - 0.5), F.lit(NAN))


def normalised_entropy(shares: list[Column]) -> Column:
    terms = [F.when(s > 0, s * F.ln(s)).otherwise(0.0) for s in shares]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    anything = F.greatest(*shares) > 0
    return F.when(anything, -total / math.log(len(shares))).otherwise(F.lit(NAN))


def bubble_size(mentions: Column) -> Column:
    return F.greatest(F.lit(60.0), F.least(F.lit(900.0), mentions * 1.2))


def defined(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


#: The words and sentences below, as the dashboard shows them.
def headline(name: Column, sigma: Column) -> Column:
    way = F.when(sigma > 0, "rose").otherwise("fell")
    how = F.when(F.abs(sigma) > 3, "the floor fell out").when(F.abs(sigma) > 2.5, "sharply").otherwise("noticeably")
    return (
        F.when(sigma < -2.5, F.concat(F.lit("The week "), how, F.lit(" for "), name, F.lit(".")))
        .when(sigma > 2.5, F.concat(name, F.lit(" "), way, F.lit(" "), how, F.lit(".")))
        .otherwise(F.concat(name, F.lit(" sentiment "), way, F.lit(" "), how, F.lit(".")))
    )
