"""Date and time functions on timestamps in microseconds, UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"SECOND": 1_000_000, "MILLIS": 1_000, "MILLISECOND": 1_000, "MICROS": 1, "MICROSECOND": 1}
_EARLIEST = "1583-01-01"
_FIELDS = {
    "YEAR": (F.year, "int"), "MONTH": (F.month, "tinyint"), "DAY": (F.dayofmonth, "tinyint"), "DAY_OF_WEEK": (F.dayofweek, "tinyint"), "WEEKDAY": (F.weekday, "tinyint"),
    "WEEK_OF_YEAR": (F.weekofyear, "tinyint"), "DAY_OF_YEAR": (F.dayofyear, "smallint"), "QUARTER": (F.quarter, "tinyint"), "HOUR": (F.hour, "tinyint"), "MINUTE": (F.minute, "tinyint"),
}


def _checked(ts: Column, value: Column, kind: str) -> Column:
    early = ts < F.lit(_EARLIEST).cast("timestamp_ntz")
    return F.when(early, F.raise_error(F.lit("dates before 1583 are not supported")).cast(kind)).otherwise(value)


def extract(field: str, ts: Column) -> Column:
    """EXTRACT: Sunday is 1 for DAY_OF_WEEK, Monday 0 for WEEKDAY; SECOND is a decimal of scale 12."""
    field = field.upper()
    if field == "SECOND":
        return _checked(ts, F.call_function("date_part", F.lit("SECOND"), ts).cast("decimal(38,12)"), "decimal(38,12)")
    build, kind = _FIELDS[field]
    return _checked(ts, build(ts).cast(kind), kind)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def since_epoch(unit: str, ts: Column) -> Column:
    """Units since 1970, toward zero."""
    return F.call_function("div", micros(ts), F.lit(UNITS[unit.upper()]).cast("bigint"))


def to_timestamp(unit: str, n: Column) -> Column:
    return F.timestamp_micros(n.cast("bigint") * UNITS[unit.upper()]).cast("timestamp_ntz")


def from_unixtime(n: Column) -> Column:
    """A timestamp, not a text."""
    return to_timestamp("SECOND", n)


def truncate(unit: str, ts: Column) -> Column:
    """Start of the unit; the value's type is kept."""
    if unit.upper() in ("MICROS", "MICROSECOND"):
        return ts
    unit = {"MILLIS": "MILLISECOND"}.get(unit.upper(), unit.upper())
    return _checked(ts, F.date_trunc(unit.lower(), ts).cast("timestamp_ntz"), "timestamp_ntz")


def now() -> Column:
    """The query's time, to the millisecond."""
    return F.date_trunc("millisecond", F.current_timestamp())
