"""Bronze rows to silver: normalising payloads, cleaning, and the latest row of each id."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..schemas import conformed


def _filled(name: str, default: str = "") -> Column:
    return F.when(F.col(name).isNull() | (F.col(name) == ""), default).otherwise(F.col(name))


def _whole(name: str) -> Column:
    return F.coalesce(F.try_to_number(F.col(name).cast("string"), F.lit("S99999999999999999999")).cast("long"), F.lit(0).cast("long"))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def archive_posts(raw: DataFrame, retrieved_at: datetime | Column, source: str = "archive") -> DataFrame:
    """Payloads of posts with defaults; the permalink is rebuilt and a body makes a self post."""
    at = retrieved_at if isinstance(retrieved_at, Column) else F.lit(retrieved_at)
    rows = raw.select(
        "id", "subreddit", _filled("author", "[deleted]").alias("author"), _whole("created_utc").alias("created_utc"), at.alias("retrieved_at"), _filled("title").alias("title"), _filled("selftext").alias("selftext"),
        _whole("score").alias("score"), _whole("num_comments").alias("num_comments"), _flag("over_18").alias("over_18"), _flag("spoiler").alias("spoiler"), "link_flair_text",
        T.post_permalink(F.col("subreddit"), F.col("id")).alias("permalink"), (_filled("selftext") != "").alias("is_self"), F.lit(source).alias("_source"),
    )
    return conformed(rows, "bronze_posts")


def archive_comments(raw: DataFrame, retrieved_at: datetime | Column, source: str = "archive") -> DataFrame:
    at = retrieved_at if isinstance(retrieved_at, Column) else F.lit(retrieved_at)
    rows = raw.select(
        "id", "subreddit", _filled("author", "[deleted]").alias("author"), _whole("created_utc").alias("created_utc"), at.alias("retrieved_at"), _filled("body").alias("body"), _whole("score").alias("score"),
        _filled("link_id").alias("link_id"), _filled("parent_id").alias("parent_id"), T.comment_permalink(F.col("subreddit"), F.col("link_id"), F.col("id")).alias("permalink"), F.lit(source).alias("_source"),
    )
    return conformed(rows, "bronze_comments")


def live_rows(raw: DataFrame, kind: str, source: str = "live") -> DataFrame:
    """Rows of the live source, whose fields come as they are but for defaults."""
    name = f"bronze_{kind}"
    text = ("title", "selftext") if kind == "posts" else ("body", "link_id", "parent_id")
    numbers = ("score", "num_comments") if kind == "posts" else ("score",)
    flags = ("over_18", "spoiler", "is_self") if kind == "posts" else ()
    made = {c: _filled(c) for c in (*text, "permalink")} | {c: _whole(c) for c in (*numbers, "created_utc")} | {c: _flag(c) for c in flags}
    return conformed(raw.withColumns(made | {"author": _filled("author", "[deleted]"), "_source": F.lit(source)}), name)


def silver_posts(bronze: DataFrame, salt: str, processed_at: Column | None = None) -> DataFrame:
    title, body = _filled("title"), _filled("selftext")
    title_gone, body_gone = T.is_deleted(title), T.is_deleted(body)
    seconds = F.coalesce("created_utc", F.lit(0))
    rows = bronze.withColumns({
        "subreddit": F.lower(F.coalesce("subreddit", F.lit(""))), "author_hash": T.author_hash(F.col("author"), salt), "created_at": F.timestamp_seconds(seconds), "created_utc": seconds,
        "title": title, "title_clean": F.when(title_gone, "").otherwise(T.clean_text(title)), "selftext": body, "selftext_clean": F.when(body_gone, "").otherwise(T.clean_text(body)),
        "score": F.coalesce("score", F.lit(0)), "num_comments": F.coalesce("num_comments", F.lit(0)), "over_18": _flag("over_18"), "spoiler": _flag("spoiler"), "is_self": _flag("is_self"),
        "permalink": F.coalesce("permalink", F.lit("")), "is_deleted": title_gone | body_gone, "_source": _filled("_source", "unknown"), "_silver_processed_at": F.current_timestamp() if processed_at is None else processed_at,
    })
    return conformed(rows, "silver_posts")


def silver_comments(bronze: DataFrame, salt: str, processed_at: Column | None = None) -> DataFrame:
    body = _filled("body")
    gone = T.is_deleted(body)
    seconds = F.coalesce("created_utc", F.lit(0))
    rows = bronze.withColumns({
        "subreddit": F.lower(F.coalesce("subreddit", F.lit(""))), "author_hash": T.author_hash(F.col("author"), salt), "created_at": F.timestamp_seconds(seconds), "created_utc": seconds,
        "body": body, "body_clean": F.when(gone, "").otherwise(T.clean_text(body)), "score": F.coalesce("score", F.lit(0)), "link_id": F.coalesce("link_id", F.lit("")), "parent_id": F.coalesce("parent_id", F.lit("")),
        "permalink": F.coalesce("permalink", F.lit("")), "is_deleted": gone, "_source": _filled("_source", "unknown"), "_silver_processed_at": F.current_timestamp() if processed_at is None else processed_at,
    })
    return conformed(rows, "silver_comments")


def latest(df: DataFrame, key: str | list[str] = "id", at: str = "retrieved_at", order: tuple[Column, ...] = ()) -> DataFrame:
    """The row of each key with the greatest `at` (null is oldest); equal ones go by `order`, ascending.

    A rank limit of one: Spark cuts each task's rows to one for a key before the shuffle, so a hot key is cheap.
    """
    keys = [key] if isinstance(key, str) else key
    rank = _own_name(df, "rank")
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at), *order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def _own_name(df: DataFrame, stem: str) -> str:
    while stem in df.columns:
        stem = f"_{stem}"
    return stem


def latest_bronze(bronze: DataFrame) -> DataFrame:
    """`latest` over files: ties go to the first file by path, then the first row in it."""
    columns = [c for c in bronze.columns if c != "_metadata"]
    rows = bronze.withColumns({"__file": F.col("_metadata.file_path"), "__row_index": F.col("_metadata.row_index")})
    return latest(rows, "id", "retrieved_at", (F.col("__file"), F.col("__row_index"))).select(columns)
