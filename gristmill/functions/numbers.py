"""Numeric functions and the arithmetic rules that differ from Spark's defaults."""

from __future__ import annotations

import decimal
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DECIMAL = T.DecimalType(38, 12)


def _raise_double(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def int_div(a: Column, b: Column) -> Column:
    """Integer division toward zero; dividing by zero raises."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def promote(a: Column) -> Column:
    """Integers compute as BIGINT."""
    return a.cast("bigint")


def absolute(x: Column) -> Column:
    return F.abs(x)


def floor(x: Column, kind: str) -> Column:
    """The type of the input, given by name, is kept."""
    return F.floor(x).cast(kind)


def ceiling(x: Column, kind: str) -> Column:
    return F.ceil(x).cast(kind)


def sqrt(x: Column) -> Column:
    x = x.cast("double")
    return _raise_double(x < 0, "SQRT: not a number", F.sqrt(x))


def exp(x: Column) -> Column:
    value = F.exp(x.cast("double"))
    return _raise_double(value == float("inf"), "EXP: out of range", value)


def power(a: Column, b: Column) -> Column:
    value = F.pow(a.cast("double"), b.cast("double"))
    return _raise_double(F.isnan(value) | (F.abs(value) == float("inf")), "POWER: out of range", value)


def true_comparison(cond: Column, *floats: Column) -> Column:
    """A comparison that is FALSE where one of the floats is NaN."""
    for x in floats:
        cond = cond & ~F.isnan(x)
    return cond


def in_list(x: Column, values: list) -> Column:
    """Membership; NULLs in the list do not make a miss unknown."""
    return x.isin([v for v in values if v is not None])


def avg_as(x: Column, kind: T.DataType, distinct: bool = False) -> Column:
    """Average of the input's own type: integers truncate, decimals keep scale 12."""
    total, n = (F.sum_distinct(x), F.count_distinct(x)) if distinct else (F.sum(x), F.count(x))
    if isinstance(kind, INTEGRAL):
        return F.when(n > 0, F.call_function("div", total.cast("bigint"), F.nullif(n, F.lit(0)))).cast(kind)
    if isinstance(kind, T.DecimalType):
        return (total / F.nullif(n, F.lit(0))).cast(DECIMAL)
    return total / F.nullif(n, F.lit(0))


def _exact(a: pd.Series, b: pd.Series, op: str) -> pd.Series:
    unit, out = Decimal(1).scaleb(-12), []
    with decimal.localcontext() as ctx:
        ctx.prec, ctx.rounding = 90, decimal.ROUND_DOWN
        for x, y in zip(a, b):
            if x is None or y is None or x != x or y != y:
                out.append(None)
                continue
            value = (x * y if op == "*" else x / y).quantize(unit)
            if abs(value) >= Decimal(10) ** 26:
                raise OverflowError("decimal out of range")
            out.append(value)
    return pd.Series(out, dtype=object)


@F.pandas_udf(DECIMAL)
def decimal_multiply(a: pd.Series, b: pd.Series) -> pd.Series:
    """Product of decimals at scale 12, truncated; Spark would shrink the scale."""
    return _exact(a, b, "*")


@F.pandas_udf(DECIMAL)
def decimal_divide(a: pd.Series, b: pd.Series) -> pd.Series:
    """Quotient of decimals at scale 12, truncated; dividing by zero raises."""
    return _exact(a, b, "/")


def as_decimal(x: Column) -> Column:
    return x.cast(DECIMAL)


def check_operands(df: DataFrame, a: str, op: str, b: str) -> None:
    """Strict mode: numbers and strings, or decimals and floats, do not mix in arithmetic."""
    kinds = [df.schema[c].dataType for c in (a, b)]
    if any(isinstance(k, T.StringType) for k in kinds):
        raise TypeError(f"{a} {op} {b}: a string is no operand of arithmetic")
    if any(isinstance(k, T.DecimalType) for k in kinds) and any(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds):
        raise TypeError(f"{a} {op} {b}: DECIMAL and FLOAT do not mix")
