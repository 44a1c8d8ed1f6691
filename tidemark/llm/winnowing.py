"""Document fingerprints by winnowing, in built-in expressions only.

A text's words (runs without ASCII white space, in lower case) are hashed to 64 bits, and every run of K words has a rolling hash: the
words' hashes, each shifted by the number of words that follow it in the run, in an exclusive or. The runs of two, four ... words
are made from those of half as many, so a run costs the logarithm of K and not K. The upper 33 bits, as a signed number, are the
hash that is kept. In every window of WINDOW runs the smallest hash is chosen, the rightmost of equal ones, with its place: hash
and place are one long, the place from behind, so that the order of longs is that of the choice, and the windows' minima are made
by doubling too. Hence two texts that share a passage of K + WINDOW - 1 words share a fingerprint, and a shared run of fewer
than K words is never one.

The likeness of two texts is the Jaccard index of their fingerprints' hashes. For a comparison with the next document
the documents are dealt in ranges of identifiers by bounds from a sample of them (which decides on tasks, not on results); the first documents of each
range are sent to the range before too, and the first of all to the last one, so one shuffle of the texts is all.

Defined results: a null text is empty; an empty or blank text has the empty fingerprint, like 1 to another one and 0 to
others; a text of fewer words than a run has one run of all of them, and one of fewer runs than a window is one window; null
identifiers come last; rows with the same identifier follow each other by text; a single row is its own next one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import SPACE

#: Words of a run, and runs of a window.
K, WINDOW = 5, 8
#: Bytes of text behind a range, about.
RANGE_BYTES = 4 << 20
#: Identifiers of the sample behind each bound, about.
SAMPLED = 100

_PLACES = (1 << 31) - 1
_BLANKS = " \t\n\x0b\x0c\r"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _beside(left: Column, right: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of the elements i of left and i + by of right, as far as right goes."""
    n = F.greatest(F.size(right) - by, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(by + 1), n), f)


def over_runs(values: Column, k: int, join: Callable[[int], Callable[[Column, Column], Column]]) -> Column:
    """What join makes of every run of k values; values has at least k.

    join(n) joins the result of a run with that of the n values behind it. Runs of two, four ... values are made first.
    """

    def doubled(powers: list[Column]) -> Column:
        m = 1 << (len(powers) - 1)
        if 2 * m <= k:
            return bound(_beside(powers[-1], powers[-1], m, join(m)), lambda more: doubled([*powers, more]))
        run, length = powers[-1], m
        for j in range(len(powers) - 2, -1, -1):
            if k >> j & 1:
                run, length = _beside(run, powers[j], length, join(1 << j)), length + (1 << j)
        return run

    return doubled([values])


def _rolled(n: int) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.shiftleft(a, n).bitwiseXOR(b)


def _least(n: int) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.least(a, b)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<long>, in order of place: of each chosen run the hash's upper 33 bits, and 2 ** 31 - 1 - place below them."""

    def placed(runs: Column) -> Column:
        return F.transform(runs, lambda g, i: g.bitwiseOR(_PLACES).bitwiseXOR(i.cast("long")))

    def chosen(packed: Column) -> Column:
        return F.when(F.size(packed) <= window, F.array(F.array_min(packed))).otherwise(F.array_distinct(over_runs(packed, window, _least)))

    def of_hashes(hashes: Column) -> Column:
        # a run of all words, if they are too few
        short = F.array(F.aggregate(hashes, F.lit(0).cast("long"), _rolled(1)))
        return bound(placed(F.when(F.size(hashes) < k, short).otherwise(over_runs(hashes, k, _rolled))), chosen)

    def of_text(trimmed: Column) -> Column:
        words = F.transform(F.split(F.lower(trimmed), SPACE), lambda w: F.xxhash64(w))
        return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(bound(words, of_hashes))

    return bound(F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS)), of_text)


def hash_of(chosen: Column) -> Column:
    return F.shiftright(chosen, 31)


def place_of(chosen: Column) -> Column:
    return chosen.bitwiseAND(_PLACES).bitwiseXOR(_PLACES)


def hashes_of(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, hash_of))


def spelled(chosen: Column) -> Column:
    """A fingerprint as a string: hash and place of each chosen run."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(hash_of(x).cast("string"), F.lit("@"), place_of(x).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard index of two fingerprints' hashes; 1 if both are empty."""

    def of(a: Column, b: Column) -> Column:
        return bound(F.size(F.array_intersect(a, b)), lambda c: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(c / (F.size(a) + F.size(b) - c)))

    return bound(hashes_of(a), lambda a: bound(hashes_of(b), lambda b: of(a, b)))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key, by a binary search."""
    line = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << j) for j in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.get(line, lo + s - 1) <= key, lo + s).otherwise(lo)) if bounds else F.lit(0)


def with_next(rows: DataFrame, id_col: str, text_col: str, what: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """rows with next_<column> for the columns `what`, from the row with the next identifier; after the last comes the first."""
    spark = rows.sparkSession
    key = F.coalesce(F.col(id_col), F.lit((1 << 63) - 1))
    ids = rows.select(key.alias("k"), F.octet_length(text_col).alias("size"))
    n, size, least = ids.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.min("k")).first()
    parts = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    sampled = ids.select("k").sample(min(1.0, SAMPLED * parts / max(n, 1)), 1)
    found = sampled.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    bounds = sorted({b for b in found if b != least})
    p = "next_of_"
    here = _range_of(key, bounds)
    copies = bound(here, lambda r: F.array(
        F.struct(r.alias("range"), F.lit(0).alias("turn")),
        F.when((r > 0) & (F.get(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), r - 1) == key), F.struct((r - 1).alias("range"), F.lit(1).alias("turn"))),
        F.when(key == F.lit(least), F.struct(F.lit(len(bounds)).alias("range"), F.lit(2).alias("turn"))),
    ))
    dealt = rows.withColumn(f"{p}copy", F.explode(F.array_compact(copies)))
    order = Window.partitionBy(f"{p}copy.range").orderBy(f"{p}copy.turn", key, F.col(id_col).isNull(), text_col)
    out = dealt.withColumn(f"{p}next", F.lead(F.struct(*what)).over(order)).where(F.col(f"{p}copy.turn") == 0)
    return out.select(*rows.columns, *[F.col(f"{p}next.{c}").alias(f"next_{c}") for c in what])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text, chosen (see `fingerprint`) of every row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), fingerprint(text, k, window).alias("chosen"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Every document's fingerprint beside that of its edited text (the second half replaced by the beginning of the next
    document) and beside the next document's."""
    rows = with_next(fingerprints(docs, id_col, text_col, k, window), "doc_id", "text", ["text", "chosen"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "chosen", "next_chosen")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "chosen", "next_chosen", fingerprint(F.col("edited"), k, window).alias("edited_chosen"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("chosen")).alias("fingerprint"), spelled(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"), likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"),
    )
