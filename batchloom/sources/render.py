"""Rows as RFC 4180 text: the exchange form of small tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import hex_lower, quoted
from .spec import TableSpec


def cell(name: str, kind: pa.DataType) -> Column:
    """Null as an empty field, text in quotes, binary as lower-case hex, dates and times as raw counts."""
    c = F.col(f"`{name}`")
    t = pa.types
    if t.is_string(kind):
        text = quoted(c)
    elif t.is_binary(kind) or t.is_fixed_size_binary(kind):
        text = hex_lower(c)
    elif t.is_date32(kind):
        text = F.unix_date(c).cast("string")
    elif t.is_timestamp(kind) and kind.unit == "us":
        text = F.unix_micros(c.cast("timestamp")).cast("string")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def csv_lines(df: DataFrame, spec: TableSpec, order: list[str]) -> DataFrame:
    """One column ``line`` per row, sorted by ``order``; the header is ``csv_header``."""
    line = F.concat_ws(",", *[cell(c.name, c.type) for c in spec.columns]).alias("line")
    return df.orderBy(*order).select(line)


def csv_header(spec: TableSpec) -> str:
    return ",".join(c.name for c in spec.columns)
