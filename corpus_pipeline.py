"""A corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents that its predecessor kept and returns documents (the last: packed pieces); every
result is written as Parquet and read again before the next stage, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, minhash_dedup, packing, quality, substring_dedup
from gristmill.llm.common import discard, materialize, owned
from gristmill.llm.queries import tokenizer_file
from gristmill.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY, SIMILAR_PERCENT, PASSAGE_WORDS, LEAK, CAPACITY, END_ID = 0.7, 80, 13, 0.8, 1024, 2


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at least QUALITY."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(COLUMNS), rules).filter(F.col("score") >= QUALITY).select(COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the least id; rows that repeat an id go too."""
    groups = minhash_dedup.near_duplicates(docs, percent=SIMILAR_PERCENT, slots=128)
    out = docs.select(COLUMNS).join(groups.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti")
    again = materialize(out.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return out
    return out.join(again, "doc_id", "left_anti").unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of a smaller id has; documents of which nothing is left go."""
    cut = substring_dedup.remove_seen(docs, span=PASSAGE_WORDS, keep=["lang", "source"])
    cut = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), threshold=LEAK)
    return docs.select(COLUMNS).join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of CAPACITY."""
    return packing.pack(docs, *tokenizer_file(), capacity=CAPACITY, end_id=END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("substring_dedup", cut_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: Signatures, trained rules and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with owned() as keep:
            after = keep(materialize(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
