"""A seeded synthetic market: quotes by a random walk per symbol, trades at the bid or the ask.

Every row is a function of (seed, event number): Spark generates it in parallel, and the same seed gives the same data
whatever the partitioning. One event in ``trade_every`` is a trade at the quote's bid or ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BASE_PX, BAND, TICK = 1_000_000, 200_000, 100
_BUCKET = 4096


def _random(seed: int, salt: int, below: int) -> Column:
    """A number in [0, below) from the event number."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("event")), F.lit(below))


def market(spark: SparkSession, events: int, seed: int = 1, symbols: int = 100, trade_every: int = 10, start_us: int = 1_700_000_000_000_000, step_us: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(quotes, trades). 0 < bid < ask; prices stay in a band; trade ids rise; trades lie at the prevailing bid or ask.

    The walk of a symbol is a running sum in two levels (inside buckets of events, then over bucket totals), so that no
    symbol's history passes through one task; it is folded back at the edges of the band.
    """
    e = spark.range(events).withColumnRenamed("id", "event")
    e = e.select("event", _random(seed, 1, symbols).alias("s"), (_random(seed, 2, 11) - 5).alias("step"), (1 + _random(seed, 3, 5)).alias("half"), (100 * (1 + _random(seed, 4, 20))).cast("int").alias("bid_sz"), (100 * (1 + _random(seed, 5, 20))).cast("int").alias("ask_sz"), _random(seed, 6, 2).alias("buys"), F.floor(F.col("event") / _BUCKET).alias("bucket"))
    totals = e.groupBy("s", "bucket").agg(F.sum("step").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walked = e.withColumn("inside", F.sum("step").over(Window.partitionBy("s", "bucket").orderBy("event"))).join(totals.select("s", "bucket", before.alias("before")), ["s", "bucket"])
    period = 4 * BAND // TICK
    phase = F.pmod(F.col("inside") + F.col("before") + F.lit(BAND // TICK), F.lit(period))
    mid = F.lit(BASE_PX - BAND) + TICK * F.when(phase <= period // 2, phase).otherwise(F.lit(period) - phase)
    rows = walked.withColumn("mid", mid).select(
        "event", F.timestamp_micros(F.lit(start_us) + F.col("event") * step_us).alias("ts"), F.format_string("S%05d", "s").alias("sym"),
        (F.col("mid") - F.col("half") * TICK).alias("bid_px"), (F.col("mid") + F.col("half") * TICK).alias("ask_px"), "bid_sz", "ask_sz", F.lit("SYNT").alias("venue"), "buys",
    )
    trade = F.col("event") % trade_every == trade_every - 1
    trades = rows.where(trade).select("ts", "sym", F.when(F.col("buys") == 1, F.col("ask_px")).otherwise(F.col("bid_px")).alias("px"), F.least("bid_sz", "ask_sz").alias("sz"), F.when(F.col("buys") == 1, "B").otherwise("S").alias("side"), (F.col("event") + 1).alias("trade_id"), "venue")
    return rows.drop("buys").withColumnRenamed("event", "quote_id"), trades


def backfill(spark: SparkSession, days: int, events_per_day: int, last_day_us: int, **options) -> tuple[DataFrame, DataFrame]:
    """Completed days ending on the day of ``last_day_us``, spread evenly over each day."""
    day = 86_400_000_000
    start = last_day_us // day * day - (days - 1) * day
    return market(spark, days * events_per_day, start_us=start, step_us=day // events_per_day, **options)
