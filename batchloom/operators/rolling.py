"""Totals and averages over trailing periods, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timeexpr import micros, utc_day
from ..staging import stage


def day_span(df: DataFrame, ts: str) -> tuple[int | None, int | None]:
    """First and last UTC day, in days since 1970, of all rows with a timestamp."""
    at = micros(ts, df.schema[ts].dataType)
    first = df.agg(utc_day(F.min(at)).alias("lo"), utc_day(F.max(at)).alias("hi")).first()
    return first["lo"], first["hi"]


def trailing_totals(df: DataFrame, entity: str, ts: str, value: str, periods: tuple[int, ...] = (7, 30), span: tuple[int, int] | None = None) -> DataFrame:
    """For each entity and UTC day from the table's first to its last: totals of ``value`` over the trailing periods.

    Columns: entity, ``day`` (DATE) and for each period p ``sum_{p}d`` (BIGINT, 0 without activity), ``n_{p}d`` (rows
    with a value), ``day_avg_{p}d`` (sum / p, so that idle days count as zero) and ``avg_{p}d`` (sum / n, null without
    rows).

    Rows collapse to daily totals before the first shuffle, so that a hot entity costs no more than any other. Each
    daily total is exploded onto the output days it influences and grouped by entity and day; the calendar then adds
    the days without anything. The shuffle grows with entities x days, never with rows.

    Defined cases: rows with a null entity or timestamp are left out (the calendar's ends come from all rows with a
    timestamp); null values count neither in sum nor in n, but their day belongs to the entity; an empty table gives
    no rows; extra columns are never read.
    """
    longest = max(periods)
    days = df.select(F.col(entity).alias("entity"), utc_day(micros(ts, df.schema[ts].dataType)).alias("d"), F.col(value).cast("bigint").alias("v"))
    lo, hi = (F.lit(d).cast("bigint") for d in span or day_span(df, ts))
    daily = days.where(F.col("entity").isNotNull() & F.col("d").isNotNull()).groupBy("entity", "d").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("s"), F.count("v").alias("n"))
    daily = stage(daily, "daily")  # a row per entity and active day, read twice
    influence = F.explode(F.sequence(F.col("d"), F.least(F.col("d") + F.lit(longest - 1), hi)))
    out = daily.select("entity", "s", "n", F.col("d").alias("source"), influence.alias("d"))
    inside = {p: F.col("d") - F.col("source") < p for p in periods}
    sums = [F.sum(F.when(inside[p], F.col(c)).otherwise(0)).alias(f"{c}{p}") for p in periods for c in ("s", "n")]
    active = out.groupBy("entity", "d").agg(*sums)
    calendar = daily.select("entity").distinct().select("entity", F.explode(F.sequence(lo, hi)).alias("d"))
    # The calendar is far larger than the file it is exploded from, by which Spark would judge whether to broadcast it.
    full = calendar.join(active.hint("merge"), ["entity", "d"], "left")
    shown = [F.col("entity").alias(entity), F.date_from_unix_date(F.col("d").cast("int")).alias("day")]
    for p in periods:
        s, n = F.coalesce(F.col(f"s{p}"), F.lit(0).cast("bigint")), F.coalesce(F.col(f"n{p}"), F.lit(0).cast("bigint"))
        shown += [s.alias(f"sum_{p}d"), n.alias(f"n_{p}d"), (s.cast("double") / F.lit(float(p))).alias(f"day_avg_{p}d"), F.when(n > 0, s.cast("double") / n.cast("double")).alias(f"avg_{p}d")]
    return full.select(*shown)
