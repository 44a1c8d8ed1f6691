"""More of the engine's operators over the driver's tables: the layers below the rollups, and small pieces of the dashboard.

Orders and documents stand for payloads of a source. Payloads have what sources have: absent and empty fields, numbers as
text, markers of deleted texts, references, folded punctuation and runs of white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import dates as D, metrics as M, text as T
from ..operators import classify as C, dashboard as B, facts as X, silver as S, summaries as Q
from ..sources import files
from .driver_queries import _DICTIONARY, _MENTIONS_SQL, day, query, table

# payloads

_TITLES = ["[deleted]", "Order &amp; more", "  two  spaces\tand a tab ", "“quoted” — it’s…", "[removed by some mod] y", "", "a\n\n\n\nb &lt;c&gt;", None, "plain", "This post was removed"]
_BODIES = ["", "body — one", None, "[removed]", "x &quot;y&quot;  z"]


def _sql_text(value: str | None) -> str:
    return "NULL" if value is None else "E'" + value.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t") + "'"


def _sql_pick(values: list, number: str) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {_sql_text(v)}" for i, v in enumerate(values)) + " END"


def _pick(values: list, number: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (number % len(values)).cast("int"))


_STRIP = r"E' \t\n\x0b\x0c\r'"
_GONE = r"'^(\[deleted\]$|\[removed\]$|\[removed by reddit\]|\[removed by .+?\]|this comment was removed|this post was removed)'"


def _sql_gone(c: str) -> str:
    return f"coalesce(regexp_matches(trim({c}, {_STRIP}), {_GONE}, 'i'), FALSE)"


def _sql_clean(c: str) -> str:
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), *T.FOLDS.items()):
        c = f"replace({c}, {_sql_text(a)}, {_sql_text(b)})"
    return f"trim(regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g'), {_STRIP})"


_PAYLOADS = f"""payloads AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'M' || (o_custkey % 7) END AS subreddit,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'C ' || o_custkey END AS author, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) END AS created_utc,
    {_sql_pick(_TITLES, 'o_orderkey')} AS title, {_sql_pick(_BODIES, 'o_custkey')} AS selftext, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS score, o_orderkey % 4 = 0 AS over_18 FROM orders)"""


def at() -> Column:
    return F.timestamp_seconds(F.lit(1_700_000_000))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    o, k, c = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.cast("string").alias("id"), F.when(k % 11 != 0, F.concat(F.lit("M"), (c % 7).cast("string"))).alias("subreddit"), F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.concat(F.lit("C "), c.cast("string"))).alias("author"),
        F.when(k % 13 == 0, "x").otherwise(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")).alias("created_utc"), _pick(_TITLES, k).alias("title"), _pick(_BODIES, c).alias("selftext"),
        F.when(c % 3 != 0, c.cast("string")).alias("score"), F.lit(None).cast("string").alias("num_comments"), (k % 4 == 0).alias("over_18"), F.lit(None).cast("boolean").alias("spoiler"), F.lit(None).cast("string").alias("link_flair_text"),
    )


_SECONDS = "coalesce(TRY_CAST(created_utc AS BIGINT), 0)"
_AUTHOR = "substr(sha256('s:' || CASE WHEN author IS NULL OR author = '' THEN '[deleted]' ELSE lower(trim(author)) END), 1, 12)"


@query(f"""WITH {_PAYLOADS} SELECT id, coalesce(lower(subreddit), '') AS subreddit, {_AUTHOR} AS author_hash, strftime(to_timestamp({_SECONDS}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created_at,
    CASE WHEN {_sql_gone("coalesce(title, '')")} THEN '' ELSE {_sql_clean("coalesce(title, '')")} END AS title_clean, CASE WHEN {_sql_gone("coalesce(selftext, '')")} THEN '' ELSE {_sql_clean("coalesce(selftext, '')")} END AS selftext_clean,
    coalesce(CAST(score AS BIGINT), 0) AS score, over_18, coalesce(selftext, '') <> '' AS is_self, {_sql_gone("coalesce(title, '')")} OR {_sql_gone("coalesce(selftext, '')")} AS is_deleted,
    CASE WHEN subreddit IS NULL THEN '' ELSE '/r/' || subreddit || '/comments/' || id || '/' END AS permalink FROM payloads""")
def silver_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Archive payloads to bronze, and bronze to silver."""
    rows = S.silver_posts(S.archive_posts(payloads(spark, sf), at()), "s")
    return rows.select("id", "subreddit", "author_hash", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "title_clean", "selftext_clean", "score", "over_18", "is_self", "is_deleted", "permalink")


def _comments(spark: SparkSession, sf: str) -> DataFrame:
    raw = payloads(spark, sf).select("id", "subreddit", "author", "created_utc", F.col("title").alias("body"), "score", F.concat(F.lit("t3_p"), "score").alias("link_id"), F.lit(None).cast("string").alias("parent_id"))
    return S.archive_comments(raw, at())


@query(f"""WITH {_PAYLOADS} SELECT id, coalesce(lower(subreddit), '') AS subreddit, {_AUTHOR} AS author_hash, {_SECONDS} AS created_utc, CASE WHEN {_sql_gone("coalesce(title, '')")} THEN '' ELSE {_sql_clean("coalesce(title, '')")} END AS body_clean,
    coalesce('t3_p' || score, '') AS link_id, '' AS parent_id, {_sql_gone("coalesce(title, '')")} AS is_deleted, CASE WHEN subreddit IS NULL OR score IS NULL THEN '' ELSE '/r/' || subreddit || '/comments/p' || score || '/_/' || id || '/' END AS permalink FROM payloads""")
def silver_comments(spark: SparkSession, sf: str) -> DataFrame:
    return S.silver_comments(_comments(spark, sf), "s").select("id", "subreddit", "author_hash", "created_utc", "body_clean", "link_id", "parent_id", "is_deleted", "permalink")


@query(f"""WITH {_PAYLOADS} SELECT id, coalesce(title, '') AS title, coalesce(selftext, '') AS selftext, CASE WHEN author IS NULL OR author = '' THEN '[deleted]' ELSE author END AS author, {_SECONDS} AS created_utc,
    coalesce(CAST(score AS BIGINT), 0) AS score, CAST(0 AS BIGINT) AS num_comments, over_18, FALSE AS spoiler, FALSE AS is_self, '' AS permalink, 'live' AS source FROM payloads""")
def live_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the live source, whose fields come as they are but for defaults."""
    raw = payloads(spark, sf).withColumns({"retrieved_at": at(), "permalink": F.lit(None).cast("string"), "is_self": F.lit(None).cast("boolean")})
    return S.live_rows(raw, "posts").select("id", "title", "selftext", "author", "created_utc", "score", "num_comments", "over_18", "spoiler", "is_self", "permalink", F.col("_source").alias("source"))


_CLEANED = f"""cleaned AS (SELECT *, CASE WHEN {_sql_gone("coalesce(title, '')")} THEN '' ELSE {_sql_clean("coalesce(title, '')")} END AS title_clean,
    CASE WHEN {_sql_gone("coalesce(selftext, '')")} THEN '' ELSE {_sql_clean("coalesce(selftext, '')")} END AS selftext_clean FROM payloads)"""


@query(f"""WITH {_PAYLOADS}, {_CLEANED}, parts AS (SELECT id, CASE WHEN title_clean <> '' THEN title_clean ELSE coalesce(title, '') END AS a, CASE WHEN selftext_clean <> '' THEN selftext_clean ELSE coalesce(selftext, '') END AS b FROM cleaned)
    SELECT id, a || CASE WHEN a <> '' AND b <> '' THEN E'\\n\\n' ELSE '' END || b AS text FROM parts WHERE length(trim(a || b, {_STRIP})) > 0""")
def classifier_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What a model sees of a post; posts without text fall away."""
    rows = S.silver_posts(S.archive_posts(payloads(spark, sf), at()), "s")
    text = T.classifier_text(*[F.col(c) for c in ("title_clean", "title", "selftext_clean", "selftext")])
    return rows.select("id", text.alias("text")).where(T.has_text(F.col("text")))


@query(f"""WITH {_PAYLOADS}, parts AS (SELECT id, trim(coalesce(title, ''), {_STRIP}) AS a, trim(coalesce(selftext, ''), {_STRIP}) AS b FROM payloads)
    SELECT id, a || CASE WHEN a <> '' AND b <> '' THEN E'\\n\\n' ELSE '' END || b AS text FROM parts""")
def resolver_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What mentions are looked up in."""
    return payloads(spark, sf).select("id", T.resolver_text(F.col("title"), F.col("selftext")).alias("text"))


@query(f"""SELECT doc_id, sha256({_sql_clean('"text"')}) AS sha, CAST(length({_sql_clean('"text"')}) AS BIGINT) AS n_chars FROM documents""")
def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """`clean_text` over texts that compatibility normalisation leaves as they are, so SQL has it."""
    rows = table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("sha"), F.length("t").cast("long").alias("n_chars"))


# facts

_LABELS = "CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END"


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    sentiment = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), sentiment.alias("sentiment"), F.lit(0.75).alias("confidence"), F.lit("low").alias("intensity"), F.lit("about_meta").alias("target"))


@query(f"""WITH m AS (WITH {_MENTIONS_SQL}) SELECT CAST(m.doc_id AS VARCHAR) AS comment_id, 'd' || (m.doc_id % 10) AS post_id, m.character_id, m.alias_matched, m.mention_weight, {_LABELS} AS sentiment, CAST(0.75 AS DOUBLE) AS sentiment_confidence, 'low' AS intensity, d.source AS subreddit
    FROM m JOIN labels l USING (doc_id) JOIN documents d USING (doc_id)""")
def comment_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Comments joined with their classification and fanned out to mentions; the post's id loses its prefix."""
    d = table(spark, sf, "documents")
    comments = d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("t3_d"), (F.col("doc_id") % 10).cast("string")).alias("link_id"), F.col("text").alias("body"), F.col("source").alias("subreddit"), at().alias("created_at"), F.lit(0).alias("created_utc"), F.lit(1).alias("score"), F.lit(False).alias("is_deleted"), F.lit("").alias("permalink"))
    return X.comment_facts(comments, _classified(spark, sf), _DICTIONARY).select("comment_id", "post_id", "character_id", "alias_matched", "mention_weight", "sentiment", "sentiment_confidence", "intensity", "subreddit")


@query("""SELECT id, doc_id, source FROM (SELECT 'k' || (doc_id % 97) AS id, doc_id, source, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def first_in_file(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one id that were retrieved at one time: the first in the files stays (they are in order of doc_id)."""
    rows = table(spark, sf, "documents").withColumns({"id": F.concat(F.lit("k"), (F.col("doc_id") % 97).cast("string")), "retrieved_at": at()})
    return S.latest_bronze(rows.select("id", "doc_id", "source", "retrieved_at", "_metadata")).select("id", "doc_id", "source")


# small pieces

@query("SELECT 'e' || event_id AS event_id, event_type AS title, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day FROM events WHERE event_type IN ('signup', 'error')")
def events_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Signups and errors as a timeline, in order of their days."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("signup", "error"))
    line = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.col("event_type").alias("title"), D.midnight(F.to_date("ts")).alias("event_date"))
    return B.events_timeline(line).select("event_id", "title", day("event_date").alias("day"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 150000 THEN 2 WHEN o_totalprice > 100000 THEN 1 END AS INTEGER) AS intensity_number,
    coalesce(o_orderstatus, o_orderpriority) AS named, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M') AS midnight FROM orders""")
def order_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The number of an intensity, the first field that a table has, and a date's midnight."""
    o, price = table(spark, sf, "orders"), F.col("o_totalprice")
    level = F.when(price > 300000, "high").when(price > 150000, "medium").when(price > 100000, "low").otherwise("none")
    return o.select("o_orderkey", M.intensity_number(level).cast("int").alias("intensity_number"), T.first_present(["o_absent", "o_orderstatus", "o_orderpriority"], o.columns).alias("named"), F.date_format(D.midnight(F.to_date("o_orderdate")), "yyyy-MM-dd HH:mm").alias("midnight"))


@query("""SELECT n_name AS character_id, CAST(count(s_suppkey) AS INTEGER) AS alias_count, 'region ' || n_regionkey AS affiliation, '' AS notes FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def alias_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as a dictionary with their suppliers' names as aliases: the length of each list, and absent notes as empty."""
    names = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list("s_name").alias("aliases"))
    rows = table(spark, sf, "nation").join(names, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    dim = files.dim_of(rows.select(F.col("n_name").alias("id"), F.lit(None).cast("string").alias("notes"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("affiliation"), "aliases"))
    return dim.select("character_id", "alias_count", "affiliation", "notes")


_QUOTES = f"""q AS (SELECT source, CASE doc_id % 2 WHEN 0 THEN 'positive' ELSE 'negative' END AS sentiment, doc_id, n_chars,
        substr(trim("text", {_STRIP}) || CASE WHEN doc_id % 3 = 0 THEN ' — ' || substr('rest ' || repeat('x', 300), 1, 200) ELSE '' END, 1, 300) AS t FROM documents),
    best AS (SELECT *, row_number() OVER (PARTITION BY source, sentiment ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS k FROM q WHERE length(t) >= 10)"""


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("id", F.col("doc_id").cast("string"))
    posts = d.select("id", F.col("text").alias("title"), F.lit("").alias("title_clean"), F.when(F.col("doc_id") % 3 == 0, "rest " + "x" * 300).otherwise("").alias("selftext_clean"), F.col("n_chars").alias("score"), F.col("source").alias("subreddit"), F.lit("/x").alias("permalink"))
    f = d.select(F.col("id").alias("post_id"), F.col("source").alias("character_id"), F.when(F.col("doc_id") % 2 == 0, "positive").otherwise("negative").alias("sentiment"))
    return Q.quotes(f, posts)


@query(f"WITH {_QUOTES} SELECT source AS character_id, sentiment, t AS text, n_chars AS score, source AS subreddit, 'https://reddit.com/x' AS permalink FROM best WHERE k <= 8")
def flattened_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Both camps' quotes as rows again, as they are displayed."""
    return Q.flattened(_quotes(spark, sf))


@query(f"WITH {_QUOTES} SELECT source AS character_id, sentiment, string_agg('  - (' || n_chars || '↑) ' || t, E'\\n' ORDER BY k) AS block FROM best WHERE k <= 8 GROUP BY ALL")
def quote_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes as the lines of a prompt."""
    return _quotes(spark, sf).select("character_id", "sentiment", T.quote_block(F.col("examples")).alias("block"))


@query("""SELECT o_orderpriority AS character_id, CASE WHEN o_orderpriority < '2' THEN 'warmest' WHEN o_orderpriority < '3' THEN 'coldest' ELSE 'most_polarising' END AS category FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def character_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries in order of their category."""
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("character_id")).distinct()
    return B.summaries(rows.withColumn("category", F.when(F.col("character_id") < "2", "warmest").when(F.col("character_id") < "3", "coldest").otherwise("most_polarising")))


@query("""SELECT doc_id, '{"quality":' || quality || ',"toxic":' || toxic || '}' AS json FROM labels""")
def labels_as_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.to_json(F.struct("quality", "toxic")).alias("json"))


@query("""SELECT doc_id, CAST(4 AS INTEGER) AS messages, '{"sentiment": "mixed"}' AS answer, 'user' AS last_role, "text" AS last FROM documents""")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A chat for each text: the system's prompt, an example with its answer, and the text last."""
    rows = table(spark, sf, "documents").select("doc_id", C.chat(F.col("text"), "rules", [("a case", {"sentiment": "mixed"})]).alias("chat"))
    last = F.element_at("chat", -1)
    return rows.select("doc_id", F.size("chat").alias("messages"), F.get("chat", F.lit(2))["content"].alias("answer"), last["role"].alias("last_role"), last["content"].alias("last"))
