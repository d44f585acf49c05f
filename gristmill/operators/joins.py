"""Joins with the predicates of the data model: pre-join, join and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest estimated size of a side that is broadcast by choice; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Size of a frame as the optimizer estimates it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size allows one."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def inner(left: DataFrame, right: DataFrame, on: Column | list[str] | str, where: Column | None = None) -> DataFrame:
    out = left.join(right, on, "inner")
    return out if where is None else out.filter(where)


def left_outer(left: DataFrame, right: DataFrame, on: Column, pre: Column | None = None, where: Column | None = None) -> DataFrame:
    """Rows of the left side that fail ``pre`` match nothing; ``where`` filters after the padding."""
    out = left.join(right, on if pre is None else (on & pre), "left")
    return out if where is None else out.filter(where)


def right_outer(left: DataFrame, right: DataFrame, on: Column, where: Column | None = None) -> DataFrame:
    out = left.join(right, on, "right")
    return out if where is None else out.filter(where)


def anti(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """Rows without a match, as LEFT JOIN ... WHERE right IS NULL gives."""
    return left.join(right, on, "left_anti")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """left.point BETWEEN right.low AND right.high as an equi-join on buckets of ``width``.

    A range is listed under every bucket it touches, a point under its own, so nothing is compared across
    buckets and no cross product arises. NULL bounds or points match nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    points = left.withColumn("_bucket", bucket(point))
    ranges = right.filter(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.join(ranges, "_bucket").filter(F.col(point).between(F.col(low), F.col(high))).drop("_bucket")


def salted(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are spread: left rows draw one of ``salts``, right rows are listed under all.

    For joins that adaptive execution cannot split, such as those below an aggregate on the key. The salt is a
    hash of the row, so a lost task redraws the same. The optimizer does not count the copies of the right rows,
    so it would broadcast many times what it estimates: the join always shuffles (a broadcast one has no use for salts).
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return a.join(b.hint("merge"), [key, "_salt"], how).drop("_salt")
