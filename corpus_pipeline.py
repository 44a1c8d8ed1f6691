"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.dedup import drop_exact_duplicates
from tidemark.llm.minhash import drop_near_duplicates
from tidemark.llm.packing import packed, special_tokens
from tidemark.llm.quality import keep_quality
from tidemark.llm.shared import delete, new_path, scope
from tidemark.llm.toxicity import drop_toxic


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's certified cutoff; null and empty texts go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't find toxic; without labels of both kinds none goes."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier; null texts are equal to empty ones."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest identifier; texts without words stay."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left; a null or empty text is one end token."""
    special = special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Trained models and minimum hashes have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stages goes with it, and its documents go when the next one is written; only
    the last table stays, for the frame that is returned."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
