"""Headliners, their best quotes, and summaries by an injected summariser."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..schemas import ddl, schema
from .classify import with_retries
from .dashboard import TOP, top

CATEGORIES = ("warmest", "coldest", "most_polarising")
PER_CAMP, LEAST_CHARS = 8, 10
_KEYS = ("text", "score", "subreddit", "permalink")


def headliners(totals: DataFrame, dim: DataFrame, n: int = TOP, entity: str = "character_id") -> DataFrame:
    """The warmest, coldest and most polarising of the n most mentioned; one that comes again is dropped.

    Undefined indices count as -1. Ties go to more mentions, then to the smaller id.
    """
    few = top(totals, n, entity).join(dim.select(entity, F.col("display_name").alias("__name")), entity, "left")
    few = few.withColumn("display_name", F.coalesce("__name", F.col(entity))).drop("__name")
    index = F.coalesce(F.nanvl("polarisation_index", F.lit(-1.0)), F.lit(-1.0))
    orders = (F.desc("mean_sentiment_score"), F.asc("mean_sentiment_score"), index.desc())
    # the inputs are n rows, so windows over all of them are cheap
    placed = few.withColumns({f"__{k}": F.row_number().over(Window.orderBy(o, F.desc("total_mentions"), entity)) for k, o in zip(CATEGORIES, orders, strict=True)})
    rank = F.when(F.col("__warmest") == 1, 0).when(F.col("__coldest") == 1, 1).when(F.col("__most_polarising") == 1, 2)
    first = placed.withColumn("__rank", rank).where("__rank is not null")
    category = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("__rank"))
    return first.select(entity, "display_name", category.alias("category"), F.col("total_mentions").alias("mentions"), "mean_sentiment_score", "polarisation_index")


def quotes(facts: DataFrame, posts: DataFrame, per_camp: int = PER_CAMP, entity: str = "character_id") -> DataFrame:
    """entity, sentiment and the best positive and negative quotes by score, as an array.

    Top-k by window with a rank limit, which Spark cuts in each task before the shuffle, so a hot entity stays cheap.
    """
    text = T.quote_text(T.first_filled(F.col("title_clean"), F.col("title")), F.col("selftext_clean"))
    items = posts.select(F.col("id").alias("post_id"), text.alias("text"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("subreddit", F.lit("")).alias("subreddit"), F.concat(F.lit("https://reddit.com"), F.coalesce("permalink", F.lit(""))).alias("permalink"))
    rows = facts.where(F.col("sentiment").isin("positive", "negative")).select("post_id", entity, "sentiment").join(items.where(F.length("text") >= LEAST_CHARS), "post_id")
    best = Window.partitionBy(entity, "sentiment").orderBy(F.desc("score"), "post_id")
    kept = rows.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= per_camp)
    collected = F.sort_array(F.collect_list(F.struct("__rank", *_KEYS)))
    return kept.groupBy(entity, "sentiment").agg(F.transform(collected, lambda q: F.struct(*[q[k].alias(k) for k in _KEYS])).alias("examples"))


def flattened(found: DataFrame, entity: str = "character_id") -> DataFrame:
    """A row for each quote: entity, sentiment and the quote's fields."""
    return found.select(entity, "sentiment", F.inline("examples"))


def camps(found: DataFrame, entity: str = "character_id") -> DataFrame:
    """entity, positive_examples, negative_examples."""
    kind = "array<struct<text: string, score: bigint, subreddit: string, permalink: string>>"
    wide = found.groupBy(entity).agg(*[F.coalesce(F.first(F.when(F.col("sentiment") == s, F.col("examples")), ignorenulls=True), F.array().cast(kind)).alias(f"{s}_examples") for s in ("positive", "negative")])
    return wide


#: The camps whose quotes a category's prompt has.
CAMPS = {"warmest": ("positive",), "coldest": ("negative",), "most_polarising": ("positive", "negative")}
ATTEMPTS, WAITS = 4, (2.0, 30.0)


def prompt_of(head: dict) -> str:
    """What a model is asked about a headliner: its camps' quotes with their scores, and the fields of the answer."""
    camps = CAMPS[head["category"]]
    blocks = [f"The {c} posts with the highest scores:\n" + "\n".join(f"  - ({q['score']}↑) {q['text']}" for q in head[f"{c}_examples"]) for c in camps]
    return "\n\n".join([f"About {head['display_name']}.", *blocks, f"Answer with a JSON object that has a text for each of: {', '.join(camps)}."])


def texts_of(response: str, category: str) -> tuple[str, str]:
    """The positive and the negative text of an answer, empty for a camp that wasn't asked for; ValueError if one is missing."""
    answer = json.loads(response)
    for c in CAMPS[category]:
        if not isinstance(answer.get(c), str) or not answer[c].strip():
            raise ValueError(f"no {c} text: {response}")
    return tuple(answer[c].strip() if c in CAMPS[category] else "" for c in ("positive", "negative"))


def by_camps(chat: Callable[[list[dict]], str], rules: dict[str, str], attempts: int = ATTEMPTS, waits: tuple[float, float] = WAITS) -> Callable[[dict], tuple[str, str]]:
    """A summariser for `summarised` from a model that answers messages; rules: the system's prompt of each category."""

    def summarise(head: dict) -> tuple[str, str]:
        messages = [{"role": "system", "content": rules[head["category"]]}, {"role": "user", "content": prompt_of(head)}]
        return with_retries(lambda: texts_of(chat(messages), head["category"]), attempts, *waits)

    return summarise


def summarised(heads: DataFrame, examples: DataFrame, summarise: Callable[[dict], tuple[str, str]], model: str, version: str, entity: str = "character_id") -> DataFrame:
    """char_summary rows: summarise gets a headliner with its quotes and gives both camps' texts; if it fails, none.

    A headliner without quotes of each camp that its category asks for is left out and the model not asked. Quotes and
    text of a camp that isn't asked for stay empty, and an absent index becomes 0. Three rows at most, so they go through the driver.
    """
    from datetime import UTC, datetime

    spark, out = heads.sparkSession, []
    for row in heads.join(examples, entity, "left").orderBy("category").collect():
        d = row.asDict(recursive=True)
        asked = CAMPS[d["category"]]
        for c in ("positive", "negative"):
            d[f"{c}_examples"] = (d.get(f"{c}_examples") or []) if c in asked else []
        if not all(d[f"{c}_examples"] for c in asked):
            continue
        try:
            texts = dict(zip(("positive", "negative"), summarise(d), strict=True))
        except Exception:  # noqa: BLE001  a summary that can't be had is left out
            continue
        said = {f"{c}_summary": text if c in asked else "" for c, text in texts.items()}
        index = 0.0 if d["polarisation_index"] is None else d["polarisation_index"]
        out.append({**d, **said, "character_id": d[entity], "polarisation_index": index, "generated_at": datetime.now(UTC), "model": model, "prompt_version": version})
    names = schema("char_summary").names
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in out], ddl("char_summary"))
