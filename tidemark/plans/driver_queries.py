"""The engine's operators applied to the driver's tables, each with SQL for an independent engine where SQL can say it.

Orders stand for facts: a priority is an entity, a status a sentiment, the order's day its time. Sums of doubles are
rounded, as their order isn't fixed; NaN is mapped to null, and dates to text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import dates as D, metrics as M, text as T
from ..operators import anomalies as A, classify as C, dashboard as B, evaluation as E, facts as X, mentions as N, rankings as R, rollups as U, silver as S, summaries as Q
from ..operators.automaton import mentions_by_automaton
from ..sources import files
from ..streaming import incremental as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(c: Column | str, places: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.when(F.isnan(c), None).otherwise(c), places)


def day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# facts from orders

FACTS = """facts AS (
    SELECT o_orderkey AS id, o_orderpriority AS character_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, 'm' || (o_custkey % 7) AS subreddit,
        CASE o_orderstatus WHEN 'O' THEN 'positive' WHEN 'F' THEN 'negative' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'mixed' ELSE 'neutral' END END AS sentiment,
        CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'F' THEN -1.0 ELSE 0.0 END AS sentiment_score,
        CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 150000 THEN 'medium' ELSE 'low' END AS intensity,
        1.0 / (1 + o_custkey % 3) AS mention_weight, 0.5 + (o_orderkey % 5) / 10.0 AS sentiment_confidence,
        CASE WHEN o_custkey % 4 = 0 THEN 'comment' ELSE 'post' END AS kind
    FROM orders)"""

WEEKLY = (
    FACTS
    + """, rows_ AS (
    SELECT *, CAST(year(created_at) AS INTEGER) AS year, CAST(week(created_at) AS INTEGER) AS week, date_trunc('week', created_at) AS week_start, mention_weight * sentiment_confidence AS w FROM facts),
sums AS (
    SELECT character_id, year, week, week_start, count(*) AS n, sum(CASE WHEN kind = 'post' THEN 1 ELSE 0 END) AS posts, sum(CASE WHEN kind = 'comment' THEN 1 ELSE 0 END) AS comments,
        sum(w) AS total, sum(sentiment_score * w) / nullif(sum(w), 0) AS mean,
        sum(CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN sentiment = 'negative' THEN 1 ELSE 0 END) AS g,
        sum(CASE WHEN sentiment = 'mixed' THEN 1 ELSE 0 END) AS m, sum(CASE WHEN sentiment = 'neutral' THEN 1 ELSE 0 END) AS u,
        sum(CASE WHEN intensity = 'high' THEN 1 ELSE 0 END) AS h
    FROM rows_ GROUP BY ALL),
weeks AS (
    SELECT character_id, year, week, week_start, CAST(n AS BIGINT) AS mention_count, CAST(posts AS BIGINT) AS post_count, CAST(comments AS BIGINT) AS comment_count, coalesce(total, 0.0) AS weighted_sentiment, coalesce(mean, 0.0) AS mean_sentiment_score,
        p / n AS share_positive, g / n AS share_negative, m / n AS share_mixed, u / n AS share_neutral, h / n AS share_high_intensity,
        CASE WHEN p + g > 0 THEN 1.0 - 2.0 * abs(p / (p + g) - 0.5) END AS polarisation_index,
        -(CASE WHEN p > 0 THEN p / n * ln(p / n) ELSE 0 END + CASE WHEN g > 0 THEN g / n * ln(g / n) ELSE 0 END + CASE WHEN m > 0 THEN m / n * ln(m / n) ELSE 0 END + CASE WHEN u > 0 THEN u / n * ln(u / n) ELSE 0 END) / ln(4) AS polarisation_entropy
    FROM sums)"""
)

TOTALS = (
    WEEKLY
    + """, t0 AS (
    SELECT character_id, sum(mention_count) AS n, sum(mean_sentiment_score * mention_count) / nullif(sum(mention_count), 0) AS mean,
        sum(share_positive * mention_count) AS p, sum(share_negative * mention_count) AS g, sum(share_mixed * mention_count) AS m, sum(share_neutral * mention_count) AS u
    FROM weeks GROUP BY character_id),
totals AS (
    SELECT character_id, CAST(n AS BIGINT) AS total_mentions, coalesce(mean, 0.0) AS mean_sentiment_score,
        CASE WHEN p + g > 0 THEN 1.0 - 2.0 * abs(p / (p + g) - 0.5) END AS polarisation_index,
        -(CASE WHEN p > 0 THEN p / n * ln(p / n) ELSE 0 END + CASE WHEN g > 0 THEN g / n * ln(g / n) ELSE 0 END + CASE WHEN m > 0 THEN m / n * ln(m / n) ELSE 0 END + CASE WHEN u > 0 THEN u / n * ln(u / n) ELSE 0 END) / ln(4) AS polarisation_entropy
    FROM t0)"""
)

DIM = ", dim AS (SELECT DISTINCT o_orderpriority AS character_id, 'P ' || o_orderpriority AS display_name FROM orders)"


def facts(spark: SparkSession, sf: str) -> DataFrame:
    o, status = table(spark, sf, "orders"), F.col("o_orderstatus")
    sentiment = F.when(status == "O", "positive").when(status == "F", "negative").when(F.col("o_orderkey") % 2 == 0, "mixed").otherwise("neutral")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("character_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")).alias("subreddit"),
        sentiment.alias("sentiment"), M.sentiment_score(sentiment).alias("sentiment_score"), F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 150000, "medium").otherwise("low").alias("intensity"),
        (1.0 / (1 + F.col("o_custkey") % 3)).alias("mention_weight"), (0.5 + (F.col("o_orderkey") % 5) / 10.0).alias("sentiment_confidence"), F.when(F.col("o_custkey") % 4 == 0, "comment").otherwise("post").alias("kind"),
    )


def parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = facts(spark, sf)
    return f.where("kind = 'post'").drop("kind"), f.where("kind = 'comment'").drop("kind")


def weeks(spark: SparkSession, sf: str) -> DataFrame:
    return U.weekly(X.all_facts(*parts(spark, sf)))


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranked(U.all_time(weeks(spark, sf)))


def dim(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("character_id").distinct().withColumn("display_name", F.concat(F.lit("P "), "character_id"))


_SHARES = ["share_positive", "share_negative", "share_mixed", "share_neutral", "share_high_intensity"]
_MEASURES = ["mean_sentiment_score", "polarisation_index", "polarisation_entropy"]
_R = lambda names, prefix="": ", ".join(f"round({prefix}{n}, 6) AS {n}" for n in names)


@query(f"WITH {WEEKLY} SELECT character_id, year, week, strftime(week_start, '%Y-%m-%d') AS week_start, mention_count, post_count, comment_count, {_R(['weighted_sentiment', *_SHARES, *_MEASURES])} FROM weeks")
def weekly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    w = weeks(spark, sf)
    return w.select("character_id", "year", "week", day("week_start").alias("week_start"), "mention_count", "post_count", "comment_count", *[rounded(c).alias(c) for c in ("weighted_sentiment", *_SHARES, *_MEASURES)])


@query(f"""WITH {TOTALS} SELECT character_id, total_mentions, {_R(_MEASURES)},
    CAST(row_number() OVER (ORDER BY coalesce(polarisation_index, -1) DESC, total_mentions DESC, character_id) AS INTEGER) AS polarisation_rank,
    CAST(row_number() OVER (ORDER BY total_mentions DESC, character_id) AS INTEGER) AS most_mentioned_rank FROM totals""")
def alltime_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return totals(spark, sf).select("character_id", "total_mentions", *[rounded(c).alias(c) for c in _MEASURES], "polarisation_rank", "most_mentioned_rank")


MOMENTS = (
    WEEKLY
    + """, based AS (
    SELECT character_id, week_start, year, mean_sentiment_score AS sentiment_score, mention_count, avg(mean_sentiment_score) OVER w AS m, stddev_pop(mean_sentiment_score) OVER w AS s, count(*) OVER w AS k
    FROM weeks WINDOW w AS (PARTITION BY character_id ORDER BY week_start, year ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
moments AS (SELECT character_id, week_start, sentiment_score, m AS baseline_mean, s AS baseline_std, (sentiment_score - m) / s AS z_score, mention_count FROM based WHERE mention_count >= 10 AND k = 12 AND s > 0 AND abs((sentiment_score - m) / s) > 2)"""
)


def moments(spark: SparkSession, sf: str) -> DataFrame:
    return A.anomalies(weeks(spark, sf))


_Z = ["sentiment_score", "baseline_mean", "baseline_std", "z_score"]


@query(f"WITH {MOMENTS} SELECT character_id, strftime(week_start, '%Y-%m-%d') AS week_start, {_R(_Z)}, mention_count FROM moments")
def zscore_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return moments(spark, sf).select("character_id", day("week_start").alias("week_start"), *[rounded(c).alias(c) for c in _Z], "mention_count")


#: A timeline for the tables' years; two events are equally far from some weeks.
TIMELINE = [("e0", "1995-03-08"), ("e1", "1995-03-06"), ("e2", "1996-01-01"), ("e3", "1996-12-30"), ("e4", "1997-06-09"), ("e5", "1997-06-23"), ("e6", "1998-02-15"), ("e7", "1999-09-17"), ("e8", "2000-12-31"), ("e9", "2001-05-05")]
_TIMELINE_SQL = "timeline(event_id, event_date, pos) AS (VALUES " + ", ".join(f"('{e}', TIMESTAMP '{d}', {k})" for k, (e, d) in enumerate(TIMELINE)) + ")"


def timeline(spark: SparkSession) -> DataFrame:
    rows = [(e, f"title of {e}", d, k, k % 2 == 0) for k, (e, d) in enumerate(TIMELINE)]
    return spark.createDataFrame(rows, "event_id string, title string, d string, pos int, verified boolean").withColumn("event_date", F.to_timestamp("d")).drop("d")


@query(f"""WITH {WEEKLY}, {_TIMELINE_SQL}, days AS (SELECT DISTINCT week_start FROM weeks),
    near AS (SELECT week_start, event_id, abs(date_diff('day', week_start, event_date)) AS d, row_number() OVER (PARTITION BY week_start ORDER BY abs(date_diff('day', week_start, event_date)), pos) AS k FROM days, timeline WHERE abs(date_diff('day', week_start, event_date)) <= 7)
    SELECT strftime(days.week_start, '%Y-%m-%d') AS week_start, event_id AS paired_event_id, 'title of ' || event_id AS paired_event_title, CAST(d AS INTEGER) AS paired_event_distance_days FROM days LEFT JOIN near ON near.week_start = days.week_start AND k = 1""")
def nearest_event(spark: SparkSession, sf: str) -> DataFrame:
    return A.nearest_event(weeks(spark, sf).select("week_start").distinct(), timeline(spark)).withColumn("week_start", day("week_start"))


@query(f"WITH {TOTALS}{DIM} SELECT character_id, display_name, total_mentions, {_R(_MEASURES)} FROM totals JOIN dim USING (character_id) ORDER BY total_mentions DESC, character_id LIMIT 3")
def top_characters(spark: SparkSession, sf: str) -> DataFrame:
    return B.top_characters(totals(spark, sf), dim(spark, sf), 3).select("character_id", "display_name", "total_mentions", *[rounded(c).alias(c) for c in _MEASURES])


@query(f"""WITH {TOTALS}{DIM} SELECT character_id, display_name, year, strftime(week_start, '%Y-%m-%d') AS week_start, mention_count FROM weeks JOIN dim USING (character_id)
    WHERE character_id IN (SELECT character_id FROM totals ORDER BY total_mentions DESC, character_id LIMIT 3)""")
def headline_weekly(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.headline_weekly(weeks(spark, sf), totals(spark, sf), dim(spark, sf), 3)
    return rows.select("character_id", "display_name", "year", day("week_start").alias("week_start"), "mention_count")


@query(f"""WITH {TOTALS}{DIM} SELECT character_id, display_name, round(polarisation_index, 6) AS polarisation_index FROM totals JOIN dim USING (character_id) WHERE total_mentions >= 50 ORDER BY polarisation_index DESC NULLS LAST, character_id LIMIT 10""")
def polarisation_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return B.polarisation_ranking(totals(spark, sf), dim(spark, sf)).select("character_id", "display_name", rounded("polarisation_index").alias("polarisation_index"))


@query(f"WITH {MOMENTS}{DIM} SELECT character_id, display_name, strftime(week_start, '%Y-%m-%d') AS week_start, round(z_score, 6) AS z_score FROM moments JOIN dim USING (character_id) ORDER BY week_start DESC, character_id LIMIT 10")
def latest_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return B.latest_anomalies(moments(spark, sf), dim(spark, sf)).select("character_id", "display_name", day("week_start").alias("week_start"), rounded("z_score").alias("z_score"))


@query(f"""WITH {MOMENTS}{DIM} SELECT character_id, strftime(week_start, '%Y.%m.%d') || ' · ' || upper(strftime(week_start, '%a')) AS date_line,
    CASE WHEN z_score < -2.5 THEN 'The week ' || CASE WHEN abs(z_score) > 3 THEN 'the floor fell out' ELSE 'sharply' END || ' for ' || display_name || '.'
         WHEN z_score > 2.5 THEN display_name || ' rose ' || CASE WHEN abs(z_score) > 3 THEN 'the floor fell out' ELSE 'sharply' END || '.'
         ELSE display_name || ' sentiment ' || CASE WHEN z_score > 0 THEN 'rose' ELSE 'fell' END || ' noticeably.' END AS headline
    FROM moments JOIN dim USING (character_id)""")
def anomaly_headlines(spark: SparkSession, sf: str) -> DataFrame:
    return B.cards(moments(spark, sf).join(dim(spark, sf), "character_id")).select("character_id", "date_line", "headline")


@query(f"""WITH {TOTALS}{DIM}, few AS (SELECT character_id FROM totals ORDER BY total_mentions DESC, character_id LIMIT 3)
    SELECT display_name, subreddit, count(*) AS mention_count FROM facts JOIN few USING (character_id) JOIN dim USING (character_id) GROUP BY ALL""")
def source_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return B.source_breakdown(parts(spark, sf), totals(spark, sf), dim(spark, sf), 3)


_SOURCES = [f"m{i}" for i in range(7)]


@query(f"""WITH {FACTS}{DIM} SELECT display_name, {', '.join(f"CAST(sum(CASE WHEN subreddit = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s in _SOURCES)}, count(*) AS total FROM facts JOIN dim USING (character_id) GROUP BY display_name""")
def source_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return B.source_pivot(B.source_breakdown(parts(spark, sf), totals(spark, sf), dim(spark, sf), 100), _SOURCES)


_NAMES = ["P 1-URGENT", "P 2-HIGH", "P 3-MEDIUM", "P 4-NOT SPECIFIED", "P 5-LOW"]


@query(f"""WITH {WEEKLY}, r AS (SELECT 'P ' || character_id AS name, CAST(year(week_start) AS VARCHAR) || '-W' || lpad(CAST(week(week_start) AS VARCHAR), 2, '0') AS week_label, row_number() OVER (PARTITION BY character_id, year(week_start), week(week_start) ORDER BY year DESC, week_start DESC) AS k, mean_sentiment_score FROM weeks)
    SELECT week_label, {', '.join(f"round(max(CASE WHEN name = '{n}' THEN mean_sentiment_score END), 6) AS c{n[2]}" for n in _NAMES)} FROM r WHERE k = 1 GROUP BY week_label""")
def weekly_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = weeks(spark, sf).withColumn("display_name", F.concat(F.lit("P "), "character_id"))
    return B.weekly_pivot(rows, _NAMES).select("week_label", *[rounded(F.col(f"`{n}`")).alias(f"c{n[2]}") for n in _NAMES])


@query(f"""WITH {TOTALS} SELECT arg_max(character_id, mean_sentiment_score) AS warmest, arg_min(character_id, mean_sentiment_score) AS coldest, arg_max(character_id, polarisation_index) AS most_polarising, CAST(sum(total_mentions) AS BIGINT) AS total_mentions FROM totals""")
def hero_stats(spark: SparkSession, sf: str) -> DataFrame:
    few = B.top(totals(spark, sf))
    return B.hero_stats(few).join(B.total_mentions(few))


@query(f"WITH {TOTALS} SELECT 'P ' || character_id AS display_name, round(mean_sentiment_score, 6) AS x, round(polarisation_index, 6) AS y, greatest(60.0, least(900.0, total_mentions * 1.2)) AS z FROM totals WHERE polarisation_index IS NOT NULL")
def bubbles(spark: SparkSession, sf: str) -> DataFrame:
    return B.bubbles(totals(spark, sf).join(dim(spark, sf), "character_id")).select("display_name", rounded("x").alias("x"), rounded("y").alias("y"), F.col("z").cast("double").alias("z"))


@query(f"""WITH {TOTALS}, p AS (SELECT *, row_number() OVER (ORDER BY mean_sentiment_score DESC) AS a, row_number() OVER (ORDER BY mean_sentiment_score) AS b, row_number() OVER (ORDER BY coalesce(polarisation_index, -1) DESC) AS c FROM totals)
    SELECT character_id, 'P ' || character_id AS display_name, CASE WHEN a = 1 THEN 'warmest' WHEN b = 1 THEN 'coldest' ELSE 'most_polarising' END AS category, total_mentions AS mentions FROM p WHERE a = 1 OR b = 1 OR c = 1""")
def headliners(spark: SparkSession, sf: str) -> DataFrame:
    return Q.headliners(totals(spark, sf), dim(spark, sf)).select("character_id", "display_name", "category", "mentions")


# silver: latest rows, upserts, text

@query("""SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1""")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return S.latest(e, "user_id", "ts", (F.col("event_id"),)).select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type")


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role, text) AS k FROM conversations) WHERE k = 1""")
def latest_turn(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", (F.col("role"), F.col("text")))


@query("""WITH n AS (SELECT event_id, user_id, event_type || '*' AS event_type FROM events WHERE value >= 50)
    SELECT * FROM n UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM n)""")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All events, of which the large ones come again corrected."""
    e = table(spark, sf, "events")
    new = e.where("value >= 50").select("event_id", "user_id", F.concat("event_type", F.lit("*")).alias("event_type"))
    return X.upsert(e.select("event_id", "user_id", "event_type"), new, ["event_id"])


@query("""SELECT c_custkey, substr(sha256('s1:' || lower(trim(c_name))), 1, 12) AS author_hash FROM customer""")
def author_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", T.author_hash(F.concat(F.lit(" "), F.upper("c_name"), F.lit("\t")), "s1").alias("author_hash"))


@query("""SELECT doc_id, 'v1:' || substr(sha256("text"), 1, 12) AS key FROM documents""")
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.cache_key(F.col("text"), "v1").alias("key"))


_MARKS = ["[deleted]", " [Removed]\n", "[removed by Reddit] x", "[removed by some mod] y", "This comment was removed by", "this post was removed", "[deleted] not", "x [deleted]", "ok", ""]
_MARKS_SQL = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MARKS)) + " END"


@query(rf"""SELECT event_id, regexp_matches(regexp_replace({_MARKS_SQL}, '^\s+|\s+$', '', 'g'), '^(\[deleted\]$|\[removed\]$|\[removed by reddit\]|\[removed by .+?\]|this comment was removed|this post was removed)', 'i') AS is_deleted FROM events""")
def deletion_flag(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.array(*[F.lit(m) for m in _MARKS])
    return table(spark, sf, "events").select("event_id", T.is_deleted(F.get(marks, (F.col("event_id") % 10).cast("int"))).alias("is_deleted"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'p' || user_id ELSE CAST(user_id AS VARCHAR) END AS post_id,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE '/r/' || event_type || '/comments/' || event_id || '/' END AS permalink,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE '/r/' || event_type || '/comments/' || CASE WHEN event_id % 2 = 0 THEN 'p' || user_id ELSE CAST(user_id AS VARCHAR) END || '/_/' || event_id || '/' END AS comment_permalink FROM events""")
def permalinks(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    link = F.when(even, F.concat(F.lit("t3_p"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    name, key = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")), F.col("event_id").cast("string")
    return table(spark, sf, "events").select("event_id", T.without_prefix(link).alias("post_id"), T.post_permalink(name, key).alias("permalink"), T.comment_permalink(name, link, key).alias("comment_permalink"))


@query()
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: NFKC and character references; tests hold it against a plain restatement."""
    rows = table(spark, sf, "pages").select("page_id", T.clean_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.sha2("t", 256).alias("sha"), F.length("t").cast("long").alias("n_chars"))


_DICTIONARY = (
    N.Entity("one", (N.Alias("with the", "substring", 0.7), N.Alias("the", "word_boundary", 0.9))),
    N.Entity("two", (N.Alias("and", "word_boundary", 0.8), N.Alias("tion", "substring", 0.6))),
    N.Entity("three", (N.Alias("for", "word_boundary", 0.95), N.Alias("qu", "requires_context", 0.5))),
    N.Entity("four", (N.Alias("idiot", "word_boundary", 1.0), N.Alias("clown", "substring", 1.0))),
)
_ALIAS_SQL = "aliases(character_id, pos, alias, mode, weight) AS (VALUES " + ", ".join(f"('{e.id}', {k}, '{a.string}', '{a.mode}', CAST({a.weight} AS DOUBLE))" for e in _DICTIONARY for k, a in enumerate(e.aliases)) + ")"
_MENTIONS_SQL = f"""{_ALIAS_SQL}, texts AS (SELECT doc_id, lower("text") AS t FROM documents),
    gated AS (SELECT *, {' OR '.join(f"contains(t, '{i}')" for i in N.indicators(_DICTIONARY))} AS gate FROM texts),
    hits AS (SELECT doc_id, character_id, alias, weight, row_number() OVER (PARTITION BY doc_id, character_id ORDER BY pos) AS k FROM gated, aliases
        WHERE CASE mode WHEN 'word_boundary' THEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || alias || '($|[^\\p{{L}}\\p{{N}}_])') WHEN 'requires_context' THEN gate AND contains(t, alias) ELSE contains(t, alias) END)
    SELECT doc_id, character_id, alias AS alias_matched, weight AS mention_weight FROM hits WHERE k = 1"""


@query(f"WITH {_MENTIONS_SQL}")
def mentions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return N.with_mentions(docs, F.col("text"), _DICTIONARY).drop("text")


@query(f"WITH {_MENTIONS_SQL}")
def mentions_by_join(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary as a table."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mentions_by_automaton(docs, F.col("text"), files.alias_table(spark, _DICTIONARY), ["doc_id"])


@query(f"""WITH m AS (WITH {_MENTIONS_SQL}) SELECT m.doc_id, m.character_id, m.alias_matched, CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment, CASE WHEN l.toxic = 1 THEN -1.0 WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END AS sentiment_score FROM m JOIN labels l USING (doc_id)""")
def classified_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents joined with a label as their classification, and fanned out to their mentions."""
    sentiment = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    labels = table(spark, sf, "labels").select("doc_id", sentiment.alias("sentiment"), F.lit(1.0).alias("confidence"), F.lit("low").alias("intensity"), F.lit("about_meta").alias("target"))
    rows = N.with_mentions(X.classified(table(spark, sf, "documents").select("doc_id", "text"), labels, "doc_id"), F.col("text"), _DICTIONARY)
    return rows.select("doc_id", "character_id", "alias_matched", "sentiment", M.sentiment_score(F.col("sentiment")).alias("sentiment_score"))


# evaluation

_PAIRS = "pairs AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS actual, CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS predicted FROM labels)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("actual"), F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("predicted"))


@query(f"WITH {_PAIRS} SELECT actual, predicted, count(*) AS count FROM pairs GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(pairs(spark, sf))


@query(f"""WITH {_PAIRS}, names(label) AS (VALUES ('good'), ('bad'), ('other')), s AS (SELECT label, sum(CASE WHEN actual = label AND predicted = label THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN actual <> label AND predicted = label THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN actual = label AND predicted <> label THEN 1 ELSE 0 END) AS fn FROM names, pairs GROUP BY label),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM s)
    SELECT label, round_even(p, 3) AS precision, round_even(r, 3) AS recall, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 3) AS f1, CAST(tp + fn AS BIGINT) AS support FROM r""")
def per_class(spark: SparkSession, sf: str) -> DataFrame:
    return E.per_class(pairs(spark, sf), ["good", "bad", "other"])


@query(f"WITH {_PAIRS} SELECT round_even(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 3) AS accuracy FROM pairs")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return E.accuracy(pairs(spark, sf))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.col("props").alias("text"), *[F.concat(F.lit("x"), (n % m).cast("string")).alias(f"expected_{a}") for a, m in zip(E.AXES, (2, 3, 5), strict=True)])
    guess = rows.select("id", *[F.when(F.col("id") % k == 0, "x0").otherwise(F.col(f"expected_{a}")).alias(a) for a, k in zip(E.AXES, (4, 6, 7), strict=True)])
    return E.judged(rows, guess)


_JUDGED = """judged AS (SELECT event_id, event_type, event_id % 4 = 0 AND event_id % 2 <> 0 AS s, event_id % 6 = 0 AND event_id % 3 <> 0 AS i, event_id % 7 = 0 AND event_id % 5 <> 0 AS t FROM events)"""


@query(f"WITH {_JUDGED} SELECT event_type AS category, count(*) AS total, CAST(sum(CASE WHEN s OR i OR t THEN 0 ELSE 1 END) AS BIGINT) AS all_correct FROM judged GROUP BY event_type")
def eval_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return E.by_category(_cases(spark, sf))


@query(f"WITH {_JUDGED} SELECT event_id AS id, event_type AS category, concat_ws(',', CASE WHEN s THEN 'sentiment' END, CASE WHEN i THEN 'intensity' END, CASE WHEN t THEN 'target' END) AS wrong_axes FROM judged WHERE s OR i OR t")
def eval_misses(spark: SparkSession, sf: str) -> DataFrame:
    return E.misses(_cases(spark, sf)).select("id", "category", F.array_join("wrong_axes", ",").alias("wrong_axes"))


# quotes, samples, windows, marks, cache

@query("""WITH d AS (SELECT doc_id, source, doc_id % 2 AS camp, trim("text", E' \\t\\n\\x0b\\x0c\\r') AS t, n_chars FROM documents), q AS (SELECT source, CASE camp WHEN 0 THEN 'positive' ELSE 'negative' END AS sentiment, doc_id, n_chars, row_number() OVER (PARTITION BY source, camp ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS k FROM d WHERE length(substr(t, 1, 300)) >= 10)
    SELECT source, sentiment, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(n_chars AS VARCHAR), ',' ORDER BY k) AS scores FROM q WHERE k <= 8 GROUP BY ALL""")
def topk_quotes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("id", F.col("doc_id").cast("string"))
    posts = d.select("id", F.col("text").alias("title"), F.lit("").alias("title_clean"), F.lit("").alias("selftext_clean"), F.col("n_chars").alias("score"), F.col("source").alias("subreddit"), F.lit("/x").alias("permalink"))
    f = d.select(F.col("id").alias("post_id"), F.col("source").alias("character_id"), F.when(F.col("doc_id") % 2 == 0, "positive").otherwise("negative").alias("sentiment"))
    q = Q.quotes(f, posts)
    return q.select(F.col("character_id").alias("source"), "sentiment", F.size("examples").cast("long").alias("n"), F.array_join(F.transform("examples", lambda e: e["score"].cast("string")), ",").alias("scores"))


@query("SELECT event_id, event_type FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    return B.sample(table(spark, sf, "events").select("event_id", "event_type"), 50, 7, "event_id")


@query(f"""WITH {_TIMELINE_SQL} SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE EXISTS (SELECT 1 FROM timeline WHERE o_orderdate >= event_date - INTERVAL 7 DAY AND o_orderdate < event_date + INTERVAL 7 DAY)""")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", day("o_orderdate").alias("day"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_utc"))
    return files.in_windows(o, files.event_windows(timeline(spark))).drop("created_utc")


@query("""WITH m AS (SELECT event_type, max(user_id) // 2 AS mark FROM events GROUP BY event_type) SELECT event_id, events.event_type, user_id FROM events LEFT JOIN m USING (event_type) WHERE user_id > coalesce(mark, 0)""")
def above_watermark(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    marks = I.advance_marks(spark.createDataFrame([], "event_type string, mark long"), e, ["event_type"], "user_id").withColumn("mark", F.floor(F.col("mark") / 2).cast("long"))
    return I.above_marks(e, marks, ["event_type"], "user_id")


@query("""SELECT CASE WHEN "text" IN (SELECT "text" FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS n FROM documents GROUP BY 1""")
def cache_split(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents' texts are what the cache knows."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    one = F.struct(F.lit("neutral").alias("sentiment"), F.lit(1.0).alias("confidence"), F.lit("low").alias("intensity"), F.lit("about_meta").alias("target"))
    keys = docs.select("id", T.cache_key(F.col("text"), "v1", T.ALL_DIGITS).alias("key"))  # before the join, so that it moves no texts
    cache = keys.join(labels, "id", "left_semi").select("key", one.alias("result"))
    hits, misses = C.split_by_cache(docs, cache, "v1", T.ALL_DIGITS)
    return hits.select(F.lit("hit").alias("outcome")).union(misses.select(F.lit("miss"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 172800 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age, strftime(ts, '%Y') || '-W' || strftime(ts, '%V') AS week_label
    FROM (SELECT event_id, ts, CAST(floor(epoch(TIMESTAMP '2030-01-01') - epoch(ts)) AS BIGINT) % 400000 AS s FROM events)""")
def date_labels(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    then = F.timestamp_seconds(F.floor(F.lit(1893456000) - F.unix_micros(ts) / 1000000) % 400000)
    return table(spark, sf, "events").select("event_id", D.human_age(F.timestamp_seconds(F.lit(0)), then).alias("age"), D.week_label(ts).alias("week_label"))


@query("""WITH q AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 ELSE 0.0 END AS confidence, CASE event_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'mixed' ELSE 'sad' END AS sentiment FROM events)
    SELECT event_id, sentiment, CAST(confidence AS DOUBLE) AS confidence FROM q WHERE confidence <= 1 AND sentiment <> 'sad'""")
def valid_responses(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    c = F.when(n % 4 == 0, "0.4").when(n % 4 == 1, "1.0").when(n % 4 == 2, "1.5").otherwise("0.0")
    s = F.when(n % 3 == 0, "positive").when(n % 3 == 1, "mixed").otherwise("sad")
    text = F.concat(F.lit('{"sentiment": "'), s, F.lit('", "confidence": '), c, F.lit(', "intensity": "high", "target": "about_arc"}'))
    return C.valid_responses(table(spark, sf, "events").select("event_id", text.alias("response"))).select("event_id", "sentiment", "confidence")
