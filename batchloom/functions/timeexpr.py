"""Timestamp arithmetic on epoch microseconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

MICROS_PER_DAY = 86_400_000_000


def micros(column: str | Column, kind: T.DataType | None = None) -> Column:
    """Epoch microseconds (BIGINT) of a TIMESTAMP, or of a TIMESTAMP_NTZ read as UTC."""
    c = F.col(column) if isinstance(column, str) else column
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.unix_micros(c)


def floor_div(value: Column, unit: int) -> Column:
    """Whole units in an integer, rounded down; exact for all of BIGINT, unlike a division of doubles."""
    return F.call_function("div", value - F.pmod(value, F.lit(unit)), F.lit(unit)).cast("bigint")


def utc_day(column: str | Column) -> Column:
    """Days since 1970-01-01 in UTC, from epoch microseconds."""
    return floor_div(F.col(column) if isinstance(column, str) else column, MICROS_PER_DAY)
