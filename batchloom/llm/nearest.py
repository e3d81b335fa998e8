"""Matching by nearest time through tick expansion.

Time is cut into discrete ticks. Every right row is exploded onto each tick from which a left row can lie within the
tolerance; of those that reach a tick from outside, the nearest on either side is kept per entity and tick, and the left
rows find the two by an equi-join on entity and tick. Timestamps here are finer than any affordable tick, so that the
right rows of the tick itself compete as well: an exact step inside the tick finds the last one before and the first one
after each left row by a running value, and the nearest of the four is the match. The result is exact at full resolution
whatever the width of a tick.

The width trades copies of right rows (a share of 2 x tolerance / width is copied, and reduced to two per tick before the
shuffle) against the rows of one group, which never exceed those of one entity in one tick: a hot entity is spread over
all of its ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeexpr import floor_div, micros


def nearest(left: DataFrame, right: DataFrame, entity: str, ts: str, left_key: str, right_key: str, tolerance_us: int = 1_000_000, tick_us: int = 20_000_000) -> DataFrame:
    """(left_key, right_key, distance_us) for each left row that has a right row of its entity within the tolerance.

    Of equally near right rows the earlier wins, and of those at one timestamp the one with the smallest key.

    Defined cases: left rows without entity or timestamp match nothing, right rows without entity, timestamp or key
    are no candidates; each left row, repeated ones included, is matched on its own; empty tables give no rows; only
    the named columns are read, so that others may clash.
    """
    def rows(df: DataFrame, key: str, side: int) -> DataFrame:
        part = df.select(F.col(entity).alias("e"), micros(ts, df.schema[ts].dataType).alias("t"), F.col(key).cast("bigint").alias("k"))
        part = part.where("e IS NOT NULL AND t IS NOT NULL")
        return (part.where("k IS NOT NULL") if side == 0 else part).withColumn("side", F.lit(side))

    tick = lambda t: floor_div(t, tick_us)
    candidates, asking = rows(right, right_key, 0), rows(left, left_key, 1)
    own = tick(F.col("t"))

    # From outside: the nearest right row on either side of each tick.
    reached = candidates.withColumn("tick", F.explode(F.array_except(F.sequence(tick(F.col("t") - tolerance_us), tick(F.col("t") + tolerance_us)), F.array(own))))
    last = F.max(F.when(F.col("tick") > own, F.struct("t", F.bitwise_not("k").alias("k")))).alias("last")
    first = F.min(F.when(F.col("tick") < own, F.struct("t", "k"))).alias("first")
    nearest_of_tick = reached.groupBy("e", "tick").agg(last, first)

    # Inside: running values in time order, both ways.
    both = candidates.unionAll(asking).withColumn("tick", own)
    group = Window.partitionBy("e", "tick")
    so_far = lambda *by: group.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    forwards = so_far(F.col("t"), F.col("side"), F.col("k").desc())
    backwards = so_far(F.col("t").desc(), F.col("side").desc(), F.col("k").desc())
    is_right = F.col("side") == 0
    t, k = F.when(is_right, F.col("t")), F.when(is_right, F.col("k"))
    seen = both.select("e", "tick", "t", "k", "side", F.last(t, True).over(forwards).alias("t0"), F.last(k, True).over(forwards).alias("k0"), F.last(t, True).over(backwards).alias("t1"), F.last(k, True).over(backwards).alias("k1"))

    met = seen.where("side = 1").join(nearest_of_tick, ["e", "tick"], "left")
    candidate = lambda t, k: F.when(t.isNotNull(), F.struct(F.abs(F.col("t") - t).alias("d"), t.alias("t"), k.alias("k")))
    best = F.least(candidate(F.col("t0"), F.col("k0")), candidate(F.col("t1"), F.col("k1")), candidate(F.col("last.t"), F.bitwise_not(F.col("last.k"))), candidate(F.col("first.t"), F.col("first.k")))
    matched = met.select(F.col("k").alias("left_key"), best.alias("best")).where(F.col("best.d") <= tolerance_us)
    return matched.select(F.col("left_key").alias(left_key), F.col("best.k").alias(right_key), F.col("best.d").alias("distance_us"))
