"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents. Nulls in any column, empty tables and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trajecta.llm import best_fit_pack, minhash_dedup, quality_rules, substring_dedup, toxicity
from trajecta.llm.tables import stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the likelihood ratio."""
    return quality_rules.passing(docs, _labels(spark, sf_dir))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return toxicity.passing(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity of 0.8 or more on shingles of five words."""
    return minhash_dedup.unique(docs, minhash_dedup.Settings(percent=80))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows of 20 words that start earlier too; the rest joined by one space."""
    return substring_dedup.cleaned(docs, size=20)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens packed into sequences."""
    return best_fit_pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("minhash_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("best_fit_pack", packing),
]

# The stages use models and hashed search, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
