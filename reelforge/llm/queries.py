"""Queries op1 to op13: each applies its operator to its whole table and returns what the contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelforge.llm import embedding_dedup, language_id, minhash, mixing, quality, secrets, sentencepiece_scan, sharding, simhash, sort_means, token_output, vector_codes, warc
from reelforge.llm import sql as texts
from reelforge.llm.shared import read_table
from reelforge.llm.vocab import vocabulary


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.tokenized(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read_table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprinted(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.clustered(read_table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(read_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(read_table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_sentencepiece,
    op2_embedding_dedup,
    op3_token_output,
    op4_warc,
    op5_secrets,
    op6_mixing,
    op7_simhash,
    op8_sharding,
    op9_minhash,
    op10_quality,
    op11_sort_means,
    op12_language_id,
    op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": texts.EMBEDDINGS, "op4_warc": texts.WARC, "op5_secrets": texts.secrets(), "op11_sort_means": texts.sort_means(), "op13_vector_codes": texts.vector_codes()}
