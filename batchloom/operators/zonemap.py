"""Zone maps: row counts and closed value ranges per batch, and pruning by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import overlaps


def zone_map(df: DataFrame, keys: list[str], time: str, stat: str | None = None) -> DataFrame:
    """Per batch (``keys``): row_count, ts_min, ts_max and, with ``stat``, stat_min, stat_max.

    Nulls are ignored; a batch without any value has null bounds. One hash aggregate with partial aggregation.
    """
    out = [F.count(F.lit(1)).alias("row_count"), F.min(time).alias("ts_min"), F.max(time).alias("ts_max")]
    if stat:
        out += [F.min(stat).alias("stat_min"), F.max(stat).alias("stat_max")]
    return df.groupBy(*keys).agg(*out)


def survives(time_range: tuple | None = None, stat_range: tuple | None = None, sealed: str | Column = "sealed") -> Column:
    """Whether a batch may hold matching rows: it is in progress, or meets every given closed range.

    A missing range is a wildcard. A sealed batch with null bounds holds no value that a range could match.
    """
    keep = F.lit(True)
    if time_range is not None:
        keep &= F.coalesce(overlaps(F.col("ts_min"), F.col("ts_max"), *map(F.lit, time_range)), F.lit(False))
    if stat_range is not None:
        keep &= F.coalesce(overlaps(F.col("stat_min"), F.col("stat_max"), *map(F.lit, stat_range)), F.lit(False))
    return ~(F.col(sealed) if isinstance(sealed, str) else sealed) | keep


def with_sealed(batches: DataFrame, order: list[str], within: list[str] | None = None, final: bool = False) -> DataFrame:
    """``batches`` with ``sealed``: all but the last one, or all of those with rows after a final seal.

    Sealing is lazy: a full last batch stays in progress until a row arrives after it.
    """
    if final:
        return batches.withColumn("sealed", F.col("row_count") > 0)
    if within:
        last = F.lead(F.lit(True)).over(Window.partitionBy(*within).orderBy(*order))
        return batches.withColumn("sealed", last.isNotNull())
    last = batches.agg(F.max(F.struct(*order)).alias("last")).select("last").scalar()
    return batches.withColumn("sealed", ~F.struct(*order).eqNullSafe(last))


def null_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact number of nulls per batch and column."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])
