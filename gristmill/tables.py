"""Loading the driver tables as DataFrames or temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a lazy scan; filters and columns are pushed into it by the optimizer."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Register tables as temporary views under their own names."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
