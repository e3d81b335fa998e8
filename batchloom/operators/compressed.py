"""Per-key results by value-frequency compression: group by key and value before key.

The first grouping spreads a hot key over all tasks, as its values differ, and collapses repeated values before the
shuffle. What is left, one row per distinct value with its weight, stays spread: counts, extremes, totals, modes and last
values are partial aggregates of it. For medians the weights are added up in buckets of one per cent of the value, and
only in the bucket that holds the middle values are counted up one by one. No task ever holds all values of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeexpr import micros
from ..staging import stage
from .batching import small


BUCKETS = 64  # to one doubling of the value


def bucket(v: Column) -> Column:
    """A number that rises with the value, in steps of about one per cent."""
    size = F.abs(v.cast("double"))
    return F.when(v == 0, 0).otherwise(F.signum(v.cast("double")) * (1 + F.floor(F.log2(size) * BUCKETS))).cast("int")


def per_key(df: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """Per field and key: rows, values, distinct_values, lowest, highest, total, mode, median, last_value.

    ``rows`` counts all rows of the key, ``values`` the non-null ones. ``mode`` is the most frequent value, the
    smallest of equally frequent ones. ``median`` is exact (mean of the middle two). ``last_value`` stands at the
    latest timestamp on which the field has a value, the largest of several; null if none has a timestamp. ``total``
    is DECIMAL(38,0). Rows with null key form one group with key null. Without any value all but ``rows``, ``values``
    and ``distinct_values`` are null. An empty table gives no rows; extra columns are never read.
    """
    at = micros(ts, df.schema[ts].dataType)
    readings = df.select(
        F.col(key).alias("key"),
        at.alias("at"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("bigint").alias("v")) for i, f in enumerate(fields)])).alias("r"),
    ).select("key", "at", "r.f", "r.v")
    weighted = readings.groupBy("key", "f", "v").agg(F.count(F.lit(1)).alias("w"), F.max("at").alias("at"))
    has = F.col("v").isNotNull()
    arranged = stage(weighted.withColumn("held", F.when(has, F.col("w")).otherwise(0)), "weights")
    out = arranged.groupBy("key", "f").agg(
        F.sum("w").alias("rows"),
        F.sum("held").alias("values"),
        F.count("v").alias("distinct_values"),
        F.min("v").alias("lowest"),
        F.max("v").alias("highest"),
        F.sum(F.col("v").cast("decimal(19,0)") * F.col("w").cast("decimal(18,0)")).cast("decimal(38,0)").alias("total"),
        F.max_by("v", F.when(has, F.struct(F.col("w"), -F.col("v").cast("decimal(19,0)")))).alias("mode"),
        F.max_by("v", F.when(has & F.col("at").isNotNull(), F.struct("at", "v"))).alias("last_value"),
    )
    # The middle two of n weighted values: the first with a running weight of at least, and of more than, half.
    valued = arranged.where(has).withColumn("bucket", bucket(F.col("v")))
    group = Window.partitionBy("key", "f")
    shares = valued.groupBy("key", "f", "bucket").agg(F.sum("w").alias("share"))
    shares = shares.select("key", "f", "bucket", (F.sum("share").over(group.orderBy("bucket")) - F.col("share")).alias("before"), "share", F.sum("share").over(group).alias("all"))
    middle = shares.where("(2 * before < all AND 2 * (before + share) >= all) OR (2 * before <= all AND 2 * (before + share) > all)")
    met = valued.alias("r").join(small(middle).alias("m"), F.expr("r.bucket = m.bucket AND r.f = m.f AND r.key <=> m.key")).select("r.key", "r.f", "r.bucket", "v", "w", "before", "all")
    upto = F.col("before") + F.sum("w").over(Window.partitionBy("key", "f", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = met.select("key", "f", "v", "all", upto.alias("upto"))
    lower, upper = F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("v"))), F.min(F.when(F.col("upto") * 2 > F.col("all"), F.col("v")))
    medians = ranked.groupBy("key", "f").agg(((lower.cast("double") + upper.cast("double")) / 2).alias("median"))
    out = out.alias("o").join(medians.alias("d"), F.expr("o.f = d.f AND o.key <=> d.key"), "left").select("o.*", "d.median")
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("f") + 1)
    return out.select(name.alias("field"), F.col("key").alias(key), *out.columns[2:])
