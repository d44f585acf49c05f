"""String functions. All give NULL on NULL input; out-of-range arguments raise, as SQL errors do."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def guard(bad: Column, message: str, value: Column) -> Column:
    """value, or an error on rows where ``bad`` holds; NULL conditions do not raise."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("string")).otherwise(value)



def octet_length(s: Column) -> Column:
    return F.octet_length(s).cast("bigint")


def char_length(s: Column) -> Column:
    return F.char_length(s).cast("bigint")


def char(n: Column) -> Column:
    """The character of a Unicode code point; beyond Unicode raises."""
    n = col(n)
    text = F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")
    return guard((n < 0) | (n > 0x10FFFF), "CHAR: not a code point", text)


def space(n: Column) -> Column:
    n = col(n)
    return guard(n < 0, "SPACE: negative length", F.repeat(F.lit(" "), n.cast("int")))


def lower(s: Column) -> Column:
    """Folds A-Z only."""
    return F.translate(s, _UPPER, _LOWER)


def upper(s: Column) -> Column:
    """Folds a-z only."""
    return F.translate(s, _LOWER, _UPPER)


def repeat(s: Column, n: Column) -> Column:
    n = col(n)
    return guard(n < 0, "REPEAT: negative count", F.repeat(s, n.cast("int")))


def position(part: Column, s: Column) -> Column:
    """Place of part in s from 1; 0 if absent."""
    return F.call_function("locate", col(part), s).cast("bigint")


def left(s: Column, n: Column) -> Column:
    n = col(n)
    return guard(n < 0, "LEFT: negative length", F.left(s, n.cast("int")))


def right(s: Column, n: Column) -> Column:
    n = col(n)
    return guard(n < 0, "RIGHT: negative length", F.right(s, n.cast("int")))


def concat(*parts: Column) -> Column:
    """NULL if any part is NULL or if all are empty."""
    return F.nullif(F.concat(*[col(p) for p in parts]), F.lit(""))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From a place (from 1); places before the text shorten the length."""
    start = col(start).cast("int")
    begin = F.greatest(start, F.lit(1))
    if length is None:
        return F.substring(s, begin, F.lit(2147483647))
    length = col(length).cast("int")
    return guard(length < 0, "SUBSTRING: negative length", F.substring(s, begin, F.greatest(length + F.least(start - 1, F.lit(0)), F.lit(0))))


def trim(s: Column, unit: str = " ", side: str = "both") -> Column:
    """Strips whole repeats of the string ``unit``."""
    if not unit:
        raise ValueError("TRIM: empty trim string")
    quoted = "".join("\\" + c if re.match(r"[^\w\s]", c) else c for c in unit)
    out = s
    if side in ("both", "leading"):
        out = F.regexp_replace(out, f"^(?:{quoted})+", "")
    if side in ("both", "trailing"):
        out = F.regexp_replace(out, f"(?:{quoted})+$(?![\\n\\r])", "")
    return out


def replace(s: Column, old: Column, new: Column) -> Column:
    return F.replace(s, col(old), col(new))


def overlay(s: Column, new: Column, start: Column, length: Column | None = None) -> Column:
    new, start = col(new), col(start).cast("int")
    length = F.char_length(new) if length is None else col(length).cast("int")
    return guard((start <= 0) | (length < 0), "OVERLAY: start or length out of range", F.overlay(s, new, start, length))


def format_currency(amount: Column, places: int) -> Column:
    """Comma-grouped decimal, rounded half to even; negative places round before the point."""
    if not -26 < places < 12:
        raise ValueError("FORMAT_CURRENCY: places must lie between -26 and 12")
    amount = amount.cast("decimal(38,12)")
    return F.format_number(F.bround(amount, places), max(places, 0))


def like(s: Column, pattern: str, escape: str = "\\") -> Column:
    return F.like(s, F.lit(pattern), F.lit(escape))
