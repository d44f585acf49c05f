"""The registered queries of the training-data operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, html_text, licenses, minhash_dedup, neighbours, oracles, packing, quality, sharding, substring_dedup, suffix_dedup
from gristmill.tables import table


def tokenizer_file() -> tuple[str, str]:
    """Path and split pattern of the public byte-level vocabulary; GRISTMILL_TOKENIZER overrides the path."""
    import public_tokenizers

    return os.environ.get("GRISTMILL_TOKENIZER", public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)
    return leaks.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 9).alias("similarity"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return licenses.scan(files, threshold=0.6, carry=["doc_id"])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), threshold=200).drop("kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_seen(table(spark, sf_dir, "documents"), span=13).drop("kept")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_file(), capacity=1024, end_id=2)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_licenses, op3_suffix_dedup, op4_substring_dedup, op5_neighbours, op6_html_text, op7_sharding, op8_quality, op9_minhash_dedup, op10_packing)}
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": oracles.OP1, "op2_licenses": oracles.OP2, "op3_suffix_dedup": oracles.OP3, "op4_substring_dedup": oracles.OP4, "op5_neighbours": oracles.OP5, "op9_minhash_dedup": oracles.OP9,
}
