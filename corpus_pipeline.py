"""A corpus from raw documents to training ids, in five stages over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternfish.llm import mixing, near_dedup, quality_rules, sentencepiece_codec, substring_dedup
from lanternfish.llm.common import materialize

NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 10); those that they reject go."""
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 3) at a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has (operator 9)."""
    return substring_dedup.remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in training order (operator 1), with the columns of documents."""
    return mixing.training_order(docs, marks=False)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy's SentencePiece ids, their number, and the text that they decode to (operator 6)."""
    return sentencepiece_codec.encode(docs).drop("text")


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", repeats),
    ("mixing sources", mixture),
    ("sentencepiece encoding", encoding),
]

#: Near-duplicates, substrings and ids can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents, each on what the one before kept and wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
