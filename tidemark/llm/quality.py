"""Quality rules whose cutoffs are chosen under control of false rejections.

Each document gets the counts of the rules and a junk score, the share of symbol characters in its words, in
ten-thousandths. For each stratum the labelled documents that pass the base rules are the holdout. For a cutoff
c the hypothesis is "more than alpha of the stratum's good documents have a score of at least c"; its exact
binomial p-value is P(Bin(n, alpha) <= k) with k of n good documents rejected. Cutoffs are tested from the
highest down (a fixed sequence needs no further correction and stops at the first that isn't rejected), and the
strata share delta by Bonferroni, so that with probability 1 - delta no stratum loses more than alpha of its good
documents. Among the certified cutoffs the one that rejects most junk with the fewest good documents is taken, at
the middle of its gap. A stratum without a certified cutoff rejects nothing.

The bound takes the labelled documents of a stratum as independent draws; copies among them weigh as often as they occur.

Defined results: null or empty text has no words and fails the base rules; a null stratum is a stratum; repeated
rows are judged alike; a label that is null or missing isn't used; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import free_prefix, in_batches, small, staged

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

ALPHA, DELTA = 0.03, 0.05
#: Scores are counts per so many characters, so cutoffs are integers and ties exact.
SCALE = 10_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice, the first included."""
    if len(words) < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, m = np.fromiter(map(index.__getitem__, words), np.int64, len(words)), len(index)
    pair = ids[:-2] * m + ids[1:-1]
    if m > 2_000_000:  # m cubed doesn't fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pair * m + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at ASCII white space only, \x20 and \x09-\x0D
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    return len(words), chars, sum(joined.count(c.encode()) for c in SYMBOLS), dup, repeated_words(words)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts_udf(text: pa.Array) -> pa.Array:
    rows = [rule_counts(t) for t in text.to_pylist()]
    table = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(COUNTS))], list(COUNTS))


def with_rule_counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the COUNTS, base_failed and junk_score; names get prefix, so nothing clashes."""
    p, tmp = prefix, f"{prefix}__counts"
    df = in_batches(docs).withColumn(tmp, counts_udf(F.col(text_col))).select("*", *[F.col(f"{tmp}.{c}").alias(f"{p}{c}") for c in COUNTS]).drop(tmp)
    df = df.withColumn(f"{p}base_failed", (F.col(f"{p}n_words") < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{p}n_words")))
    return df.withColumn(f"{p}junk_score", F.floor(SCALE * F.col(f"{p}n_symbols") / F.greatest(F.col(f"{p}word_chars"), F.lit(1))).cast("int"))


def binomial_cdfs(n: int, p: float, most: int) -> np.ndarray:
    """P(Bin(n, p) <= k) for k from 0 to most, below n; logarithms of factorials are summed once."""
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    i = np.arange(most + 1)
    return np.minimum(1.0, np.cumsum(np.exp(fact[n] - fact[i] - fact[n - i] + i * math.log(p) + (n - i) * math.log1p(-p))))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    return 1.0 if k >= n else float(binomial_cdfs(n, p, k)[k])


def certified_cutoff(scores: np.ndarray, good: np.ndarray, junk: np.ndarray, alpha: float, level: float) -> int | None:
    """The cutoff of one stratum, or None; scores ascending and distinct, good and junk the counts at each."""
    n = int(good.sum())
    if not n or not len(scores):
        return None
    best, best_gain, lower = None, 0.0, 0
    rejected_good, rejected_junk = np.cumsum(good[::-1])[::-1], np.cumsum(junk[::-1])[::-1]
    # beyond a share of alpha no cutoff is certified
    cdf = binomial_cdfs(n, alpha, min(n - 1, int(alpha * n) + 1))
    for i in range(len(scores) - 1, -1, -1):
        if scores[i] <= 0 or rejected_good[i] >= len(cdf) or cdf[rejected_good[i]] > level:
            break
        gain = float(rejected_junk[i]) - 10.0 * float(rejected_good[i])
        if gain > best_gain:
            best, best_gain, lower = int(scores[i]), gain, int(scores[i - 1]) if i else 0
    return None if best is None else max(1, (best + lower + 1) // 2)


def cutoffs(scored: DataFrame, labels: DataFrame, stratum: str, id_col: str = "doc_id", quality_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA, prefix: str = "") -> DataFrame:
    """stratum, cutoff, n_good, n_rejected_good, n_junk, n_rejected_junk of every stratum in the holdout.

    Only counts by (stratum, score) are gathered, at most SCALE + 1 for each stratum.
    """
    labels = labels.where(F.col(quality_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(quality_col).alias("label"))
    kept = scored.where(~F.col(f"{prefix}base_failed")).select(F.col(id_col).alias("id"), F.col(stratum).alias("stratum"), F.col(f"{prefix}junk_score").alias("score"))
    bins = kept.join(labels, "id").groupBy("stratum", "score").agg(F.sum("label").cast("long").alias("good"), F.sum(1 - F.col("label")).cast("long").alias("junk"))
    bins = staged(bins, "quality-bins")
    strata = max(1, bins.select("stratum").distinct().count())

    def choose(pdf):
        import pandas as pd

        pdf = pdf.sort_values("score")
        s, g, j = (pdf[c].to_numpy(np.int64) for c in ("score", "good", "junk"))
        c = certified_cutoff(s, g, j, alpha, delta / strata)
        over = s >= c if c is not None else np.zeros(len(s), bool)
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "cutoff": pd.array([c], "Int32"), "n_good": [g.sum()], "n_rejected_good": [g[over].sum()], "n_junk": [j.sum()], "n_rejected_junk": [j[over].sum()]})

    return bins.groupBy("stratum").applyInPandas(choose, "stratum string, cutoff int, n_good long, n_rejected_good long, n_junk long, n_rejected_junk long")


def judged(scored: DataFrame, chosen: DataFrame, stratum: str, prefix: str = "") -> DataFrame:
    """scored with `<prefix>cutoff` and `<prefix>kept`; a stratum without a cutoff keeps what passes the base rules."""
    c = small(staged(chosen.where("cutoff is not null").select(F.col("stratum").alias(f"{prefix}stratum"), F.col("cutoff").alias(f"{prefix}cutoff")), "quality-cutoffs"), 100_000)
    df = scored.join(c, F.col(stratum).eqNullSafe(F.col(f"{prefix}stratum")), "left").drop(f"{prefix}stratum")
    return df.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.coalesce(F.col(f"{prefix}junk_score") < F.col(f"{prefix}cutoff"), F.lit(True)))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the COUNTS, base_failed, junk_score, cutoff and kept of every row of docs."""
    p = "q_"
    scored = staged(with_rule_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text_col).alias("text")), "text", p).drop("text"), "quality-counts")
    out = judged(scored, cutoffs(scored, labels.select(F.col(id_col).alias("doc_id"), "quality"), "stratum", alpha=alpha, delta=delta, prefix=p), "stratum", p)
    return out.select("doc_id", *[F.col(f"{p}{c}").alias(c) for c in (*COUNTS, "base_failed", "junk_score", "cutoff", "kept")])


def keep_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs without the rejected rows; the rows are staged once with their counts, so no text is shuffled."""
    p = free_prefix(docs, "q_")
    scored = staged(with_rule_counts(docs, text_col, p), "quality-docs")
    chosen = cutoffs(scored, labels, stratum, id_col, alpha=alpha, delta=delta, prefix=p)
    return judged(scored, chosen, stratum, p).where(F.col(f"{p}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
