"""Messages delivered more than once: keep exactly one copy per identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_deliveries(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of ``df`` per non-null ``key``: the one with the smallest ``order`` columns.

    ``min_by`` over a struct keeps a single candidate per key and task, so that copies of one key collapse before the
    shuffle however many there are. Ties in ``order`` are broken by a hash of the whole row and, beyond that, concern
    rows that are equal in all columns. Nulls order last. Rows whose key is null are no copies of one another: all
    are kept. Column names may clash with nothing, as the row travels as one struct.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(*[x for c in order for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))], F.xxhash64(whole))
    kept = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).agg(F.min_by(whole, rank).alias("first_row")).select("first_row.*")
    return kept.unionAll(df.where(F.col(f"`{key}`").isNull()))


def surplus(df: DataFrame, key: str, delivery: str) -> DataFrame:
    """(key, delivery) of the rows that are not the first delivery of their non-null key.

    ``delivery`` is a number that rises with delivery. The first delivery of each key is found as in
    ``first_deliveries``, by one hash aggregation with a candidate per key and task; only keys that were counted more than
    once go back to their rows, by a join whose other side Spark may filter by them and splits where a key is hot. Rows
    that share both key and delivery number count as one delivery. A null delivery number orders after all others, and
    such a row is surplus if its key also stands on a row with a number.
    """
    rows = df.select(F.col(key).alias("key"), F.col(delivery).cast("bigint").alias("delivery")).where(F.col("key").isNotNull())
    rank = F.struct(F.col("delivery").isNull(), F.col("delivery"))
    first = rows.groupBy("key").agg(F.min_by(F.struct("delivery"), rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = rows.join(first.select("key", "first"), "key").where(~F.col("delivery").eqNullSafe(F.col("first.delivery")))
    return later.select(F.col("key").alias(key), F.col("delivery").alias(delivery))
