"""Classification by an injected model, behind a content-addressed cache.

Texts that the cache knows are joined; each distinct other text is sent once. The model is a factory, called in each
task, of a function from messages to a response; responses are checked against the labels, failures are tried again
with growing waits, and a text that keeps failing is left out.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..schemas import INTENSITIES, SENTIMENTS, TARGETS, conformed
from ..shipping import bounded
from ..staging import staged

#: What a blank text gets.
BLANK = ("neutral", 1.0, "low", "about_meta")
_RESULT = "sentiment string, confidence double, intensity string, target string"


def paced(per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[], None]:
    """A function that returns at least 1 / per_second after it did before; for one thread. Of n tasks each gets a share of 1 / n."""
    gap, free = 1.0 / per_second, [-math.inf]

    def wait() -> None:
        now = clock()
        if now < free[0]:
            sleep(free[0] - now)
        free[0] = max(now, free[0]) + gap

    return wait


def with_retries(call: Callable, attempts: int, first: float, most: float, sleep: Callable[[float], None] = time.sleep):
    """call() until it doesn't raise, at most so often, with doubling waits; the last failure is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(min(most, max(first, first * 2**k)))


def validated(response: str | dict) -> tuple[str, float, str, str]:
    """The labels of a response; ValueError if it isn't JSON or isn't within the labels and 0 to 1."""
    r = json.loads(response) if isinstance(response, str) else response
    out = (r.get("sentiment"), float(r.get("confidence", -1)), r.get("intensity"), r.get("target"))
    if out[0] not in SENTIMENTS or not 0.0 <= out[1] <= 1.0 or out[2] not in INTENSITIES or out[3] not in TARGETS:
        raise ValueError(f"not a classification: {r}")
    return out


def valid_responses(df: DataFrame, column: str = "response") -> DataFrame:
    """The same check as expressions: rows whose JSON column holds a classification, with its fields."""
    parsed = F.from_json(F.col(column), _RESULT, {"mode": "PERMISSIVE"})
    rows = df.withColumn("__r", parsed).select("*", "__r.*").drop("__r")
    return rows.where(F.col("sentiment").isin(*SENTIMENTS) & F.col("confidence").between(0, 1) & F.col("intensity").isin(*INTENSITIES) & F.col("target").isin(*TARGETS))


def messages(system: str, examples: list[tuple[str, dict]], text: str) -> list[dict]:
    """A chat: the system's prompt, each example as a question and its answer, then the text."""
    out = [{"role": "system", "content": system}]
    for question, answer in examples:
        out += [{"role": "user", "content": question}, {"role": "assistant", "content": json.dumps(answer)}]
    return [*out, {"role": "user", "content": text}]


def chat(text: Column, system: str, examples: list[tuple[str, dict]]) -> Column:
    """`messages` as an array of role and content."""
    fixed = messages(system, examples, "")[:-1]
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(*[one(m["role"], F.lit(m["content"])) for m in fixed], one("user", text))


def split_by_cache(texts: DataFrame, cache: DataFrame, version: str, digits: int = T.KEY_DIGITS) -> tuple[DataFrame, DataFrame]:
    """texts (id, text) with results from the cache (key, result), whose keys have so many digits, and the rows that it doesn't know, with keys."""
    keyed = texts.withColumn("key", T.cache_key(F.col("text"), version, digits))
    known = cache.select("key", "result").dropDuplicates(["key"])
    return keyed.join(known, "key").select("id", "text", "key", "result.*"), keyed.join(known, "key", "left_anti")


def classify(texts: DataFrame, cache: DataFrame, model: Callable[[], Callable[[str], str | dict]], version: str, model_name: str, tasks: int = 16, per_second: float = 16.0, attempts: int = 6, waits: tuple[float, float] = (2.0, 60.0), prompt: tuple[str, list[tuple[str, dict]]] | None = None, blank: tuple[str, float, str, str] | None = BLANK, digits: int = T.KEY_DIGITS) -> tuple[DataFrame, DataFrame]:
    """classifications of texts (id, text), and what is new to the cache. The model is asked here, once for both.

    prompt: the system's prompt and examples, with which the model gets a chat instead of the text alone.
    blank: what blank texts get, null ones too; with None they are classified like others, and null ones left out.
    digits: of the cache's keys, and of those by which texts count as equal.
    """
    bounded(texts.sparkSession)
    fields = ["id", "sentiment", "confidence", "intensity", "target"]
    asked = F.col("text").isNotNull() if blank is None else T.has_text(F.col("text"))
    hits, misses = split_by_cache(texts.where(asked), cache, version, digits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, wait = model(), paced(per_second / tasks)
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"], strict=True):

                def once(text=text):
                    wait()
                    return validated(call(messages(*prompt, text) if prompt else text))

                try:
                    rows.append((key, *with_retries(once, attempts, *waits)))
                except Exception:  # noqa: BLE001  the row is left out, and isn't cached
                    continue
            yield pd.DataFrame(rows, columns=["key", "sentiment", "confidence", "intensity", "target"])

    work = misses.select("key", "text").dropDuplicates(["key"]).repartition(tasks, "key")
    # staged, so that the model is asked once for both results, and not again when an executor is lost
    new = staged(work.mapInPandas(run, f"key string, {_RESULT}"), "classified")
    rows = hits.select(*fields).unionByName(misses.join(new, "key").select(*fields))
    if blank is not None:
        rows = rows.unionByName(texts.where(~asked).select("id", *[F.lit(v).alias(c) for c, v in zip(fields[1:], blank, strict=True)]))
    out = rows.withColumns({"classified_at": F.current_timestamp(), "prompt_version": F.lit(version), "model": F.lit(model_name)})
    fresh = new.select("key", F.struct("sentiment", "confidence", "intensity", "target").alias("result"), F.current_timestamp().cast("string").alias("cached_at"))
    return conformed(out, "classifications"), conformed(fresh, "cache")
