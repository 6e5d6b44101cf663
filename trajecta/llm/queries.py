"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trajecta.llm import best_fit_pack, bpe, conversation_repair, embedding_dedup, fill_in_middle, html_extract, jpeg_media, minhash_dedup, oracles, quality_rules, substring_dedup, suffix_dedup, token_store, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.label(table(spark, sf_dir, "documents"), minhash_dedup.Settings(percent=85))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.annotate(pages, html_extract.default_model())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), size=100)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.checksums(*token_store.write(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.read_media(jpeg_media.to_media(table(spark, sf_dir, "documents")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"), size=20)


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack.pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2, capacity=1024)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.label(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_html_extract": op2_html_extract,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_quality_rules": op5_quality_rules,
        "op6_token_store": op6_token_store,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_jpeg_media": op8_jpeg_media,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_best_fit_pack": op10_best_fit_pack,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": oracles.OP1,
        "op3_suffix_dedup": oracles.OP3,
        "op9_substring_dedup": oracles.OP9,
        "op11_embedding_dedup": oracles.OP11,
        "op12_fill_in_middle": oracles.OP12,
        "op13_conversation_repair": oracles.OP13,
    }
