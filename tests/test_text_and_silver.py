import hashlib
import html
import random
import re
import unicodedata
from datetime import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D, metrics as M, text as T
from tidemark.operators import silver as S
from tidemark.schemas import empty, schema


def values(spark, rows, *columns, names="a"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], ", ".join(f"{n} string" for n in names.split()))
    return [r[0] if len(columns) == 1 else tuple(r) for r in df.select(*columns).collect()]


def restated(raw):
    if not raw:
        return ""
    t = html.unescape(unicodedata.normalize("NFKC", raw)).translate(str.maketrans(T.FOLDS))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


def test_clean_text(spark):
    cases = ["‘a’ “b”", "a — b – c", "wait…", "&amp; &lt;", "a   b\t\tc", "a\n\n\n\nb", "oﬃce", None, "", "&nbsp;x", " x ", "\x1fx\x1c", "½ ﾊﾝ"]
    rng = random.Random(1)
    cases += ["".join(rng.choice("a&;#3 \t\n’…—ﬁnbsp ") for _ in range(40)) for _ in range(300)]
    assert values(spark, cases, T.clean_text(F.col("a"))) == [restated(c) for c in cases]


def test_deletion_markers(spark):
    yes = ["[deleted]", "[removed]", "[Removed by Reddit]", "[removed by reddit] later", "[ Removed by x ]".replace("[ ", "["), "[removed by mods of x] z", "This comment was removed by", "THIS POST WAS REMOVED", " [deleted]\n"]
    no = ["", None, "deleted", "[deleted] but not", "it said [removed]", "this comment is fine"]
    assert values(spark, yes + no, T.is_deleted(F.col("a"))) == [True] * len(yes) + [False] * len(no)


def test_author_hash_and_keys(spark):
    want = lambda n: hashlib.sha256(f"s:{n}".encode()).hexdigest()[:12]
    assert values(spark, ["Bob", " bob ", None, ""], T.author_hash(F.col("a"), "s")) == [want("bob"), want("bob"), want("[deleted]"), want("[deleted]")]
    assert values(spark, ["é"], T.cache_key(F.col("a"), "v2")) == ["v2:" + hashlib.sha256("é".encode()).hexdigest()[:12]]
    assert values(spark, ["t3_abc123", "abc123", "", "xt3_a"], T.without_prefix(F.col("a"))) == ["abc123", "abc123", "", "xt3_a"]
    assert values(spark, [("S", "abc"), ("S", ""), (None, "x")], T.post_permalink(F.col("a"), F.col("b")), names="a b") == ["/r/S/comments/abc/", "", ""]
    assert values(spark, [("S", "t3_p", "c"), ("S", None, "c")], T.comment_permalink(F.col("a"), F.col("b"), F.col("c")), names="a b c") == ["/r/S/comments/p/_/c/", ""]


def test_texts_of_posts(spark):
    rows = [("t", "T", "", "B"), ("", "T", "b", ""), (None, None, None, None)]
    cols = [F.col(c) for c in "abcd"]
    assert values(spark, rows, T.classifier_text(*cols), names="a b c d") == ["t\n\nB", "T\n\nb", ""]
    assert values(spark, [(" t ", "b\n"), ("", "b"), (None, None)], T.resolver_text(cols[0], cols[1]), names="a b") == ["t\n\nb", "b", ""]
    assert values(spark, [("head", "x" * 400), ("h", "")], T.quote_text(cols[0], cols[1]), names="a b") == ["head — " + "x" * 200, "h"]


def test_measures(spark):
    df = spark.createDataFrame([(50, 50), (100, 0), (0, 100), (75, 25), (25, 75), (0, 0)], "p int, g int")
    got = [r[0] for r in df.select(M.polarisation_index(F.col("p"), F.col("g"))).collect()]
    assert got[:5] == [1, 0, 0, 0.5, 0.5] and got[5] != got[5]
    df = spark.createDataFrame([(0.25, 0.25, 0.25, 0.25), (1.0, 0.0, 0.0, 0.0), (0.5, 0.5, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(M.normalised_entropy([F.col(c) for c in "abcd"])).collect()]
    assert [round(x, 9) + 0 for x in got[:3]] == [1, 0, 0.5] and got[3] != got[3]
    df = spark.createDataFrame([(3.5,), (2.7,), (2.2,), (-2.2,), (-2.7,), (-4.0,)], "z double")
    assert [r[0] for r in df.select(M.headline(F.lit("X"), F.col("z"))).collect()] == ["X rose the floor fell out.", "X rose sharply.", "X sentiment rose noticeably.", "X sentiment fell noticeably.", "The week sharply for X.", "The week the floor fell out for X."]
    ages = spark.createDataFrame([(30,), (90,), (7200,), (47 * 3600 + 5,), (49 * 3600,)], "s long").select(D.human_age(F.timestamp_seconds(F.lit(0)), F.timestamp_seconds("s")))
    assert [r[0] for r in ages.collect()] == ["just now", "1m ago", "2h ago", "47h ago", "2d ago"]


def test_payloads_to_silver(spark):
    raw = spark.createDataFrame([("p1", "CamelName", None, "1700000000", "Title", "[removed]", "100", None, None, True, None), ("p2", "", "x", "bad", "[deleted]", None, "7", "3", True, None, "f")], schema("archive_posts"))
    bronze = S.archive_posts(raw, datetime(2024, 1, 1))
    b = {r.id: r for r in bronze.collect()}
    assert (b["p1"].author, b["p1"].created_utc, b["p1"].score, b["p1"].permalink, b["p1"].is_self) == ("[deleted]", 1700000000, 100, "/r/CamelName/comments/p1/", True)
    assert (b["p2"].permalink, b["p2"].created_utc, b["p2"].selftext, b["p2"].is_self, b["p2"].over_18) == ("", 0, "", False, True)
    s = {r.id: r for r in S.silver_posts(bronze, "s").collect()}
    assert (s["p1"].subreddit, s["p1"].is_deleted, s["p1"].title_clean, s["p1"].selftext_clean, s["p1"].selftext) == ("camelname", True, "Title", "", "[removed]")
    assert s["p2"].is_deleted and s["p1"].created_at == datetime(2023, 11, 14, 22, 13, 20)
    raw = spark.createDataFrame([("c1", "S", "a", "5", "Silver &amp; co", "2", "t3_p1", "t1_x")], schema("archive_comments"))
    c = S.silver_comments(S.archive_comments(raw, datetime(2024, 1, 1)), "s").first()
    assert (c.body_clean, c.permalink, c.is_deleted, c.link_id) == ("Silver & co", "/r/S/comments/p1/_/c1/", False, "t3_p1")
    assert S.silver_posts(empty(spark, "bronze_posts"), "s").count() == 0


def test_latest_wins(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1), "early"), ("a", datetime(2024, 1, 2), "late"), ("b", None, "null"), ("b", datetime(2020, 1, 1), "dated"), ("c", datetime(2024, 1, 1), "first"), ("c", datetime(2024, 1, 1), "second")]
    df = spark.createDataFrame([(i, k, t, n) for n, (i, k, t) in enumerate(rows)], "id string, retrieved_at timestamp, title string, n int")
    assert sorted((r.id, r.title) for r in S.latest(df, order=(F.col("n"),)).collect()) == [("a", "late"), ("b", "dated"), ("c", "first")]
    for k, part in enumerate((df.where("n >= 3"), df.where("n < 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"{k}"))
    stored = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path))
    assert sorted((r.id, r.title) for r in S.latest_bronze(stored).collect()) == [("a", "late"), ("b", "dated"), ("c", "first")]


def test_first_characters_of_a_stripped_text(spark):

    rng = random.Random(2)
    texts = [None, "", " ", "\u2003a\u2003", "ab  ", "  abcdef", "abc   ", "abc  d", "abcd ", "\x1cabc\x1f\x1f"] + ["".join(rng.choice("ab \n\u3000é") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[T.first_chars(F.col("t"), n).alias(f"c{n}") for n in (1, 3, 5)]).collect()
    for r in rows:
        for n in (1, 3, 5):
            assert r[f"c{n}"] == (None if r.t is None else r.t.strip()[:n])


@pytest.mark.parametrize("step", ["clean", "join", "automaton"])
def test_python_gets_batches_of_bounded_bytes(spark, step):
    from tidemark.operators import automaton
    from tidemark.operators.mentions import Alias, Entity
    from tidemark.shipping import BATCH_BYTES

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("to be "), 20_000).alias("text"))  # 36 MB in one task, far fewer rows than a batch has by default
    entities = [Entity("a", (Alias("be"),))]
    table = spark.createDataFrame([("a", 0, "be", "substring", 1.0)], "character_id string, pos int, alias string, mode string, weight double")
    made = {
        "clean": lambda: docs.select(T.clean_text(F.col("text")).alias("t")),
        "join": lambda: automaton.mentions_by_automaton(docs, F.col("text"), table, ["id"]),
        "automaton": lambda: automaton.mentions_by_automaton(docs, F.col("text"), entities, ["id"]),
    }[step]()
    in_series = F.pandas_udf(lambda s: pd.Series([int(s.str.len().sum())] * len(s)), "long")

    def in_batch(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    assert docs.mapInArrow(in_batch, "n long").agg(F.max("n")).first()[0] < 2 * BATCH_BYTES
    assert docs.select(in_series("text").alias("n")).agg(F.max("n")).first()[0] < 2 * BATCH_BYTES
    assert made.count() == 300
