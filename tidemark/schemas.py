"""The declared schemas of the layers; every writer ends in a cast to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string  # noqa: F401

_DDL = {
    "bronze_posts": "id string, subreddit string, author string, created_utc long, retrieved_at timestamp, title string, selftext string, score long, num_comments long, over_18 boolean, spoiler boolean, link_flair_text string, permalink string, is_self boolean, _source string",
    "bronze_comments": "id string, subreddit string, author string, created_utc long, retrieved_at timestamp, body string, score long, link_id string, parent_id string, permalink string, _source string",
    "silver_posts": "id string, subreddit string, author_hash string, created_utc long, created_at timestamp, retrieved_at timestamp, title string, title_clean string, selftext string, selftext_clean string, score long, num_comments long, over_18 boolean, spoiler boolean, link_flair_text string, permalink string, is_self boolean, is_deleted boolean, _source string, _silver_processed_at timestamp",
    "silver_comments": "id string, subreddit string, author_hash string, created_utc long, created_at timestamp, retrieved_at timestamp, body string, body_clean string, score long, link_id string, parent_id string, permalink string, is_deleted boolean, _source string, _silver_processed_at timestamp",
    "classifications": "id string, sentiment string, confidence double, intensity string, target string, classified_at timestamp, prompt_version string, model string",
    "dim_character": "character_id string, display_name string, role string, affiliation string, status string, alias_count int, notes string",
    "dim_event": "event_id string, event_date timestamp, chapter int, arc string, title string, description string, spoiler_intensity string, medium string, verified boolean, characters array<string>",
    "fact_post_sentiment": "post_id string, character_id string, alias_matched string, mention_weight double, sentiment string, sentiment_score double, sentiment_confidence double, intensity string, target string, subreddit string, created_at timestamp, created_utc long, score long, num_comments long, spoiler boolean, is_deleted boolean, permalink string, title string",
    "fact_comment_sentiment": "comment_id string, post_id string, character_id string, alias_matched string, mention_weight double, sentiment string, sentiment_score double, sentiment_confidence double, intensity string, target string, subreddit string, created_at timestamp, created_utc long, score long, is_deleted boolean, permalink string",
    "agg_char_week": "character_id string, year int, week int, week_start timestamp, mention_count long, post_count long, comment_count long, weighted_sentiment double, mean_sentiment_score double, share_positive double, share_negative double, share_mixed double, share_neutral double, share_high_intensity double, polarisation_index double, polarisation_entropy double",
    "agg_polarisation": "character_id string, total_mentions long, mean_sentiment_score double, polarisation_index double, polarisation_entropy double, polarisation_rank int, most_mentioned_rank int",
    "moments": "character_id string, week_start timestamp, sentiment_score double, baseline_mean double, baseline_std double, z_score double, mention_count long, paired_event_id string, paired_event_title string, paired_event_distance_days int",
    "char_summary": "character_id string, display_name string, category string, mentions long, mean_sentiment_score double, polarisation_index double, positive_summary string, negative_summary string, positive_examples array<struct<text: string, score: long, subreddit: string, permalink: string>>, negative_examples array<struct<text: string, score: long, subreddit: string, permalink: string>>, generated_at timestamp, model string, prompt_version string",
    "dictionary": "id string, display_name string, role string, affiliation string, status string, aliases array<struct<string: string, mode: string, weight: double>>, notes string",
    "eval_case": "id string, category string, text string, expected struct<sentiment: string, intensity: string, target: string>",
    "cache": "key string, result struct<sentiment: string, confidence: double, intensity: string, target: string>, cached_at string",
    "archive_posts": "id string, subreddit string, author string, created_utc string, title string, selftext string, score string, num_comments string, over_18 boolean, spoiler boolean, link_flair_text string",
    "archive_comments": "id string, subreddit string, author string, created_utc string, body string, score string, link_id string, parent_id string",
}

NAMES = tuple(_DDL)

#: The labels a classification may have.
SENTIMENTS = ("positive", "negative", "mixed", "neutral")
INTENSITIES = ("low", "medium", "high")
TARGETS = ("about_character", "about_arc", "about_meta")


def ddl(name: str) -> str:
    return _DDL[name]


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the declared columns and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(name)])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))
