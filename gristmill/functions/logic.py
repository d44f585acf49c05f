"""Conditional and error functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(x: Column, *pairs_and_default: object) -> Column:
    """DECODE: the result of the first equal value (NULL equals NULL), else the default or NULL."""
    args = list(pairs_and_default)
    default = args.pop() if len(args) % 2 else None
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for value, result in zip(args[::2], args[1::2]):
        cond = x.eqNullSafe(lit(value))
        out = F.when(cond, lit(result)) if out is None else out.when(cond, lit(result))
    return lit(default) if out is None else out.otherwise(lit(default))


def sql_error(code: int | None = None, message: str | None = None, when: Column | None = None) -> Column:
    """Raises on rows where ``when`` holds (all, if none is given); code 0 passes through."""
    if code == 0:
        return F.lit(0).cast("bigint")
    text = message if code is None else f"{code}" if message is None else f"{code}: {message}"
    bad = F.lit(True) if when is None else when
    return F.when(bad, F.raise_error(F.lit(text)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
