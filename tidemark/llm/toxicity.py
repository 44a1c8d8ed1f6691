"""Toxicity by a classifier chain of linear models.

The categories are label columns, predicted in order. A model of a category sees the document's features and the
probabilities of the categories before it. For training these come out of fold: the sample is split in folds by a
hash of the identifier, and a document's probability comes from models fitted on the other folds, as at
prediction it comes from models that have not seen the document.

Features: presence of the vocabulary's words and beginnings of words (lower case, split at ASCII characters that aren't
letters or digits; the first PREFIXES bytes of longer words, so that inflections and new compounds of a word are known),
the share of symbol characters, the share of capitals and the logarithm of the number of words.

The classifier is fitted on a bounded sample: of the SAMPLE labelled identifiers with the smallest hashes one row each (the
smallest text), of which texts with equal words count once. The vocabulary is chosen for each category apart, by counts
made on the cluster: the features whose documents differ most from the rest, PER_WORD documents of the sample for each, LEAST
at least and MOST at most. Only the vocabulary's features of the sample reach the driver. A document is toxic from the
probability on that separates the sample's out-of-fold probabilities best (the most hits, a false alarm weighing
FALSE_ALARM hits), which the models that gave them haven't been fitted on.
Scoring reads every whole text.

Defined results: null or empty text has no words and is scored by the dense features; labels other than 0 and 1
are ignored, and so are labels of null identifiers; repeated rows get equal scores; without labels of both kinds a category's
probability is the sample's share (0 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import free_prefix, in_batches, staged

#: Labelled rows to fit on, at most.
SAMPLE = 20_000
#: Lengths of the beginnings of words, in bytes.
PREFIXES = (4, 5, 6, 7, 8)
#: Documents of the sample that must hold a feature, documents for each feature of a category, and bounds of their number.
MIN_DOCS, PER_WORD, LEAST, MOST = 4, 8, 64, 2_048
FOLDS, L2, STEPS = 5, 1e-4, 200
FALSE_ALARM = 3
DENSE = 3

_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def features_of(words: set[bytes]) -> set[bytes]:
    """The words, and beginnings of words with a star behind."""
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + b"*" for w in words if len(w) > n])
    return out


def dense_of(text: str | None, n_words: int) -> list[float]:
    t = text or ""
    n = max(1, len(t))
    return [10.0 * sum(t.count(c) for c in "#*$%&|<>!") / n, 5.0 * sum(t.count(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n, math.log1p(n_words) / 10]


@dataclass
class Linear:
    """Logistic regression: weights of features, then of the dense ones and earlier categories, then the bias."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def margin(self, sums: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return sums + dense @ self.dense + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(indices: np.ndarray, rows: np.ndarray, dense: np.ndarray, y: np.ndarray, n_words: int) -> Linear:
    """L2-regularised logistic loss by full-batch Adam; indices and rows list the nonzero features of the documents, which ascend."""
    n = len(y)
    share = float(y.mean()) if n else 0.0
    if share in (0.0, 1.0):
        return Linear(np.zeros(n_words), np.zeros(dense.shape[1]), -40.0 if share == 0.0 else 40.0)
    size = n_words + dense.shape[1] + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[-1] = math.log(share / (1 - share))
    # the features by document and by place, each in a row, so that sums are over ranges
    order = np.argsort(indices, kind="stable")
    by_place = rows[order]
    some_rows, row_at = np.unique(rows, return_index=True)
    some_places, place_at = np.unique(indices[order], return_index=True)
    sums, g = np.zeros(n), np.zeros(size)
    for step in range(1, STEPS + 1):
        if len(rows):
            sums[some_rows] = np.add.reduceat(w[indices], row_at)
        p = _sigmoid(sums + dense @ w[n_words:-1] + w[-1])
        r = (p - y) / n
        if len(rows):
            g[some_places] = np.add.reduceat(r[by_place], place_at)
        g[n_words:-1], g[-1] = dense.T @ r, r.sum()
        slope = g.copy()
        slope[:-1] += L2 * w[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w -= 0.2 / (1 + step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Linear(w[:n_words], w[n_words:-1], float(w[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on hits less FALSE_ALARM times false alarms are most, in its gap's middle; 0.5 without both kinds."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    last = np.append(p[1:] != p[:-1], True)  # a cut goes behind the last of equal ones
    gain = np.where(last, np.cumsum(y - FALSE_ALARM * (1 - y)), -np.inf)
    k = int(gain.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


@dataclass
class Chain:
    categories: tuple[str, ...]
    vocabulary: dict[bytes, int]
    models: list[Linear]
    out_of_fold: dict[str, np.ndarray]
    thresholds: dict[str, float]

    def predict(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category."""
        table = np.vstack([m.weights for m in self.models]).T if self.models else np.zeros((0, 0))
        sums, dense = np.zeros((len(texts), len(self.models))), np.zeros((len(texts), DENSE))
        known = self.vocabulary.keys()
        for i, t in enumerate(texts):
            words = words_of(t)
            dense[i] = dense_of(t, len(words))
            if hit := known & features_of(set(words)):
                sums[i] = table[[self.vocabulary[w] for w in sorted(hit)]].sum(axis=0)
        out = np.zeros((len(texts), len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = _sigmoid(model.margin(sums[:, k], np.hstack([dense, out[:, :k]])))
        return out


def fit_chain(features: Sequence[Sequence[int]], vocabulary: Sequence[bytes], dense: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: Sequence[str]) -> Chain:
    """features: of each document its features' places in the vocabulary; labels: a column for each category, NaN for none."""
    n, fold = len(features), fold % FOLDS
    rows = np.repeat(np.arange(n), [len(f) for f in features]) if n else np.zeros(0, np.int64)
    cols = np.concatenate([np.zeros(0, np.int64), *(np.asarray(f, np.int64) for f in features)])
    models, oof, thresholds = [], {}, {}
    for k, name in enumerate(categories):
        y, use = labels[:, k], ~np.isnan(labels[:, k])

        def fit(mask, dense=dense, y=y):
            at = np.cumsum(mask) - 1
            pick = mask[rows]
            return fit_linear(cols[pick], at[rows[pick]], dense[mask], y[mask], len(vocabulary))

        p = np.zeros(n)
        for f in range(FOLDS if n else 0):
            model, test = fit(use & (fold != f)), fold == f
            p[test] = _sigmoid(model.margin(np.bincount(rows, model.weights[cols], n), dense)[test])
        models.append(fit(use))
        oof[name], thresholds[name] = p, best_threshold(p[use], y[use])
        dense = np.hstack([dense, p[:, None]])
    return Chain(tuple(categories), {w: i for i, w in enumerate(vocabulary)}, models, oof, thresholds)


_MADE = T.StructType([T.StructField("digest", T.LongType()), T.StructField("features", T.ArrayType(T.BinaryType())), T.StructField("dense", T.ArrayType(T.DoubleType()))])


@F.arrow_udf(_MADE)
def made_udf(text: pa.Array) -> pa.Array:
    """A digest of each text's distinct words, its features, and its dense ones."""
    digests, features, dense = [], [], []
    for t in text.to_pylist():
        words = words_of(t)
        distinct = set(words)
        digests.append(int.from_bytes(hashlib.blake2b(b" ".join(sorted(distinct)), digest_size=8).digest(), "little", signed=True))
        features.append(sorted(features_of(distinct)))
        dense.append(dense_of(t, len(words)))
    return pa.StructArray.from_arrays([pa.array(digests, pa.int64()), pa.array(features, pa.list_(pa.binary())), pa.array(dense, pa.list_(pa.float64()))], ["digest", "features", "dense"])


def sample_of(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str, text_col: str, sample: int) -> DataFrame:
    """id, h, features, dense, y0, y1...: a row for each of `sample` labelled identifiers at most, texts with equal words once.

    Features are made once and staged in order, which compresses them well; batches are small, as they take many times a text's bytes.
    """
    ys = [f"y{i}" for i in range(len(categories))]
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.when(F.col(c).isin(0, 1), F.col(c))).cast("double").alias(y) for c, y in zip(categories, ys, strict=True)])
    marks = marks.where(F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample)
    found = in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "id")
    one = found.groupBy("id").agg(F.min("text").alias("text"), *[F.first(y).alias(y) for y in ys])
    one = staged(one.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))), "toxic-sample")
    made = staged(in_batches(one, 1 << 19).select("id", "h", *ys, made_udf("text").alias("made")).select("id", "h", "made.*", *ys), "toxic-features", "zstd")
    kept = made.groupBy("digest").agg(F.min(F.struct("h", "id")).alias("kept")).select("kept.id")
    return made.join(F.broadcast(kept), "id").select("id", "h", "features", "dense", *ys)


def vocabulary_of(rows: DataFrame, n_categories: int) -> list[bytes]:
    """The features whose documents' labels differ most from the sample's, for each category apart."""
    ys = [f"y{i}" for i in range(n_categories)]
    n, *rates = rows.select(*ys).agg(F.count("*"), *[F.coalesce(F.avg(y), F.lit(0.0)) for y in ys]).first()
    per = min(MOST, max(LEAST, n // PER_WORD))
    seen = rows.select(F.explode("features").alias("word"), *ys).groupBy("word").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(y), F.lit(0.0)).alias(y) for y in ys])
    seen = staged(seen.where(F.col("n") >= MIN_DOCS), "toxic-counts")
    out: set[bytes] = set()
    for y, rate in zip(ys, rates, strict=True):
        strength = F.abs(F.col(y) - F.col("n") * rate) / F.sqrt(F.greatest(F.col("n") * rate * (1 - rate), F.lit(1e-9)))
        out |= {bytes(r.word) for r in seen.orderBy(strength.desc(), "word").limit(per).collect()}
    return sorted(out)


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """The chain fitted on at most `sample` labelled rows; only the vocabulary's features of these reach the driver."""
    rows = sample_of(docs, labels, categories, id_col, text_col, sample)
    vocabulary = vocabulary_of(rows, len(categories))
    places = {w: i for i, w in enumerate(vocabulary)}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def placed(features: pa.Array) -> pa.Array:
        return pa.array([[places[w] for w in f if w in places] for f in features.to_pylist()], pa.list_(pa.int32()))

    ys = [f"y{i}" for i in range(len(categories))]
    got = rows.select("h", "id", placed("features").alias("at"), "dense", *ys).toArrow().combine_chunks()
    got = got.take(pc.sort_indices(got.select(["h", "id"]), [("h", "ascending"), ("id", "ascending")]))
    labels = np.array([[np.nan if v is None else v for v in got[y].to_pylist()] for y in ys], float).reshape(len(categories), len(got)).T
    dense = np.array(got["dense"].to_pylist(), float).reshape(len(got), DENSE)
    return fit_chain([a.values.to_numpy() for a in got["at"]], vocabulary, dense, labels, np.array(got["h"].to_pylist(), np.int64), categories)


def with_probabilities(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with `<prefix>p_<category>` for every category."""
    names, held = chain.categories, docs.sparkSession.sparkContext.broadcast(chain)

    @F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in names]))
    def score(text: pa.Array) -> pa.Array:
        p = held.value.predict(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(names))], list(names))

    tmp = free_prefix(docs, f"{prefix}p") + "_all"
    return in_batches(docs).withColumn(tmp, score(F.col(text_col))).select("*", *[F.col(f"{tmp}.{c}").alias(f"{prefix}p_{c}") for c in names]).drop(tmp)


#: Categories that the table of labels has, in the chain's order: documents of low quality, then toxic ones.
CATEGORIES = ("low_quality", "toxic")


def label_categories(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic of every row of docs; threshold: instead of the chosen one."""
    chain = train(docs, label_categories(labels), CATEGORIES)
    least = chain.thresholds["toxic"] if threshold is None else threshold
    out = with_probabilities(docs.select("doc_id", "text"), chain)
    return out.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES], (F.col("p_toxic") >= least).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """docs without the rows that the chain finds toxic; columns as they were."""
    chain, p = train(docs, label_categories(labels), CATEGORIES), free_prefix(docs, "t_")
    least = chain.thresholds["toxic"] if threshold is None else threshold
    return with_probabilities(docs, chain, prefix=p).where(F.col(f"{p}p_toxic") < least).select(*[F.col(f"`{c}`") for c in docs.columns])
