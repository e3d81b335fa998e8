"""Event-time windows over streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed(df: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Rows per window and key; with ``lateness`` a stream drops what comes later than that."""
    if lateness:
        df = df.withWatermark(ts, lateness)
    out = df.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "rows")


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, lateness: str | None = None) -> DataFrame:
    """Rows per session: events of one key that follow one another within ``gap``."""
    if lateness:
        df = df.withWatermark(ts, lateness)
    out = df.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "rows")
