"""Measures of a classifier against labelled cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

AXES = ("sentiment", "intensity", "target")


def half_even(c: Column, places: int = 3) -> Column:
    """Rounded half to even on the exact value of the double, as Python's round does."""
    return F.bround(c.cast("decimal(38,18)"), places).cast("double")


def accuracy(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    hit = F.avg(F.col(actual).eqNullSafe(F.col(predicted)).cast("double"))
    return pairs.agg(half_even(F.coalesce(hit, F.lit(0.0))).alias("accuracy"))


def confusion(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return pairs.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("count"))


def per_class(pairs: DataFrame, labels: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """label, precision, recall, f1 and support of every label, also of those that don't occur; one pass over pairs."""
    counts = confusion(pairs, actual, predicted)
    names = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    both = counts.join(F.broadcast(names), (F.col("actual") == F.col("label")) | (F.col("predicted") == F.col("label")))
    a, p, n = F.col("actual").eqNullSafe(F.col("label")), F.col("predicted").eqNullSafe(F.col("label")), F.col("count")
    sums = both.groupBy("label").agg(*[F.sum(F.when(c, n).otherwise(0)).alias(k) for k, c in (("tp", a & p), ("fp", ~a & p), ("fn", a & ~p))])
    rows = names.join(sums, "label", "left").na.fill(0)
    zero = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    rows = rows.withColumns({"__p": zero(F.col("tp"), F.col("tp") + F.col("fp")), "__r": zero(F.col("tp"), F.col("tp") + F.col("fn"))})
    f1 = zero(2 * F.col("__p") * F.col("__r"), F.col("__p") + F.col("__r"))
    return rows.select("label", half_even(F.col("__p")).alias("precision"), half_even(F.col("__r")).alias("recall"), half_even(f1).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def judged(cases: DataFrame, predictions: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Cases (with expected_<axis>) beside predictions, joined by id, with the array wrong_axes, sorted."""
    p = predictions.select("id", *[F.col(x).alias(f"predicted_{x}") for x in axes])
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"expected_{x}").eqNullSafe(F.col(f"predicted_{x}")), x) for x in axes]))
    return cases.join(p, "id").withColumn("wrong_axes", wrong)


def by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.size("wrong_axes") == 0).alias("all_correct"))


def misses(rows: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    nested = [F.struct(*[F.col(f"{k}_{x}").alias(x) for x in axes]).alias(k) for k in ("expected", "predicted")]
    return rows.where(F.size("wrong_axes") > 0).select("id", "category", "text", "wrong_axes", *nested)


def report(cases: DataFrame, predictions: DataFrame, labels: dict[str, Sequence[str]], version: str, model: str) -> DataFrame:
    """The whole report as one row of JSON; its parts have a row for each label, category or miss."""
    rows = judged(cases, predictions, tuple(labels))
    out = rows.agg(F.count("*").alias("eval_set_size")).withColumns({"prompt_version": F.lit(version), "model": F.lit(model)})
    for axis, names in labels.items():
        e, p = f"expected_{axis}", f"predicted_{axis}"
        classes = per_class(rows, names, e, p).agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("precision", "recall", "f1", "support")))).alias("per_class"))
        table = confusion(rows, e, p).agg(F.sort_array(F.collect_list(F.struct("actual", "predicted", "count"))).alias("confusion"))
        part = accuracy(rows, e, p).join(classes).join(table)
        out = out.join(part.select(F.struct("accuracy", "per_class", "confusion").alias(axis)))
    category = by_category(rows).agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("total", "all_correct")))).alias("per_category"))
    missed = misses(rows, tuple(labels)).agg(F.sort_array(F.collect_list(F.struct("id", "category", "text", "wrong_axes", "expected", "predicted"))).alias("misses"))
    out = out.join(category).join(missed)
    return out.select(F.to_json(F.struct("*")).alias("report"))
