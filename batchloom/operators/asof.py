"""Workload operators of quote and trade tables: as-of join, bars, volume-weighted price, reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage
from .batching import small

# A dimension is broadcast up to this many rows and so many bytes; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], tie: str | None = None) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` at or before it (same ``keys``); null if there is none.

    Of right rows at one time the one with the largest ``tie`` counts. Both sides are range-partitioned together by keys
    and time, so that a hot key spreads over tasks; a running last value is taken inside each range, and what a range
    begins with comes from the ranges before it, of which each contributes one row per key. No pairs arise.
    """
    common = [F.col(k) for k in keys] + [F.col(on)]
    carried = F.struct(*[F.col(v) for v in values])
    r = right.select(*common, F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), carried.alias("_value"), F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("_row"))
    l_ = left.select(*common, F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(r.schema["_value"].dataType).alias("_value"), F.struct("*").alias("_row"))
    both = r.unionAll(l_).repartitionByRange(*keys, on, "_side", "_tie").withColumn("_part", F.spark_partition_id())
    both = stage(both, "asof")
    latest = both.groupBy("_part", *keys).agg(F.max_by("_value", F.when(F.col("_side") == 0, F.struct(on, "_tie"))).alias("_latest"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = latest.select("_part", *keys, F.last("_latest", True).over(before).alias("_carry")).where("_carry IS NOT NULL")
    w = Window.partitionBy("_part", *keys).orderBy(on, "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last("_value", True).over(w)).where("_side = 1").alias("s")
    met = seen.join(small(carry).alias("c"), F.expr(" AND ".join(f"s.`{c}` <=> c.`{c}`" for c in ["_part", *keys])), "left")
    found = F.coalesce(F.col("s._seen"), F.col("c._carry"))
    return met.select("s._row.*", *[found[v].alias(v) for v in values])


def bars(df: DataFrame, keys: list[str], interval: Column, order: list[str], price: str, size: str) -> DataFrame:
    """Open, high, low, close, volume and volume-weighted price per keys and interval; rows without price are left out."""
    by = F.struct(*[F.col(c) for c in order])
    rows = df.where(F.col(price).isNotNull()).withColumn("interval_start", interval)
    traded = F.col(price).cast("double") * F.col(size)
    return rows.groupBy(*keys, "interval_start").agg(
        F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"),
        F.sum(size).cast("bigint").alias("volume"), (F.sum(traded) / F.sum(F.when(F.col(size) != 0, F.col(size).cast("double")))).alias("vwap"),
    )


def resolve_codes(df: DataFrame, code: str, dimension: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of a reference table looked up by ``code``; unknown codes keep nulls.

    The dimension is broadcast only after its rows and their length as text have been counted and found small.
    """
    seen = dimension.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.length(F.to_csv(F.struct("*"))))).first()
    few = seen[0] <= BROADCAST_ROWS and (seen[1] or 0) <= BROADCAST_BYTES
    return df.join(F.broadcast(dimension) if few else dimension, F.col(code) == F.col(key), "left")
