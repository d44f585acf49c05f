"""Sorting, limits, set operations, in-list scans and aggregation helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def limit_offset(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """OFFSET, then LIMIT; negative numbers are refused."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("LIMIT and OFFSET take no negative numbers")
    out = df.offset(offset) if offset else df
    return out if limit is None else out.limit(limit)


def top_k(df: DataFrame, order: list[Column], k: int, offset: int = 0) -> DataFrame:
    return limit_offset(df.orderBy(*order), k, offset)


def _alike(frames: tuple[DataFrame, ...]) -> None:
    first = [f.dataType for f in frames[0].schema.fields]
    for other in frames[1:]:
        if [f.dataType for f in other.schema.fields] != first:
            raise TypeError("set operations need the same number and types of columns")


def set_operation(kind: str, *frames: DataFrame) -> DataFrame:
    """UNION, UNION ALL, INTERSECT, INTERSECT ALL, EXCEPT or EXCEPT ALL of any number of inputs, from the left."""
    _alike(frames)
    steps = {
        "union": lambda a, b: a.union(b), "union all": lambda a, b: a.union(b), "intersect": lambda a, b: a.intersect(b), "intersect all": lambda a, b: a.intersectAll(b),
        "except": lambda a, b: a.subtract(b), "except all": lambda a, b: a.exceptAll(b),
    }
    out = reduce(steps[kind.lower()], frames)
    return out.distinct() if kind.lower() == "union" else out


def in_list_scan(spark: SparkSession, values: list, kind: str, name: str = "value", nullable: bool = False) -> DataFrame:
    """One sorted column of the list's distinct values; NULL stays only where the column allows it."""
    rows = [(v,) for v in values if nullable or v is not None]
    return spark.createDataFrame(rows, f"{name} {kind}").distinct().orderBy(name)


def values_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def count_range(df: DataFrame, key: str, low: object = None, high: object = None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """COUNT(*) over a key range; NULL keys do not count."""
    cond = F.col(key).isNotNull()
    if low is not None:
        cond &= (F.col(key) > low) if low_open else (F.col(key) >= low)
    if high is not None:
        cond &= (F.col(key) < high) if high_open else (F.col(key) <= high)
    return df.filter(cond).agg(F.count(F.lit(1)).alias("n"))


def group_by_key(df: DataFrame, keys: list[str], aggs: list[Column], carried: list[str]) -> DataFrame:
    """Group by a primary key and carry columns that depend on it."""
    return df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried], *aggs)


def having(df: DataFrame, cond: Column, limit: int | None = None, offset: int = 0) -> DataFrame:
    return limit_offset(df.filter(cond), limit, offset)


def key_hash_range(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows whose key hashes into a range."""
    return df.filter(F.hash(key).between(low, high))
