"""A corpus pipeline from the training-data operators: STAGES in order, run() and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the
shared folder and read again as the next stage's docs. All stages but the last return the columns of
documents. Documents without doc_id can't be grouped, so near_copies keeps them all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, decontaminate, jaccard_join, pii, quality
from tidewatch.llm.shared import forget, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels that aren't held out."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, shingle_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data in text are replaced by their kind; n_chars follows."""
    return pii.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and what they decode to, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: The classifier's model can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, table(stage(spark, docs, sf_dir), name)
        if k:  # a stage's table, which its successor has read to the end
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
