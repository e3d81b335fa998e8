"""Operators of problems 1, 3, 4 and 7 on small fixtures: definitions in plain Python, and every defined edge case."""

import random
from datetime import date, datetime, timezone
from statistics import median

import pytest
from pyspark.sql import functions as F

from batchloom.operators.compressed import per_key
from batchloom.operators.dedup import first_deliveries, surplus
from batchloom.operators.rolling import trailing_totals
from batchloom.operators.spikes import bad_readings

DAY = 86_400_000_000


def ticks(spark, rows, *more):
    """rows: (micros, sym, key, a, b)."""
    df = spark.createDataFrame(rows, "us bigint, sym string, key bigint, a bigint, b bigint").withColumn("ts", F.timestamp_micros("us"))
    return df.select("*", *[F.lit("clash").alias(c) for c in more])


def plain_bad(rows, k):
    """Problem 1 by its definition, for one field."""
    series = {}
    for us, sym, key, *v in rows:
        if sym is not None and v[k] is not None:
            series.setdefault((sym, None if us is None else us // DAY), []).append((-(1 << 63) if us is None else us, key, v[k]))
    steps, pairs, out = {}, {}, set()
    for (sym, _), s in series.items():
        s.sort()
        for x, y in zip(s, s[1:]):
            pairs.setdefault(sym, []).append(x[2] != y[2])
            if x[2] != y[2]:
                steps.setdefault(sym, []).append(abs(x[2] - y[2]))
    for (sym, _), s in series.items():
        v = [x[2] for x in s]
        for i, (_, key, x) in enumerate(s):
            before, after = v[max(0, i - 5) : i], v[i + 1 : i + 6]
            if x <= 0:
                out.add(key)
            if len(before) >= 3 and len(after) >= 3 and sym in steps:
                a, b, far = x - median(before), x - median(after), 20 * median(steps[sym])
                if (a > far and b > far) or (a < -far and b < -far):
                    out.add(key)
            lo = hi = i
            while lo and v[lo - 1] == x:
                lo -= 1
            while hi + 1 < len(v) and v[hi + 1] == x:
                hi += 1
            if hi - lo >= 14 and 2 * sum(pairs[sym]) > len(pairs[sym]):
                out.add(key)
    return out


@pytest.mark.parametrize("seed, chunk", [(1, 7), (2, 40), (3, 100_000)])
def test_bad_readings_match_definition_across_chunk_edges(spark, seed, chunk):
    r = random.Random(seed)
    rows, key = [], 0
    for sym in ("A", "B", None, "C"):
        px = 1000
        for i in range(240):
            key += 1
            px += r.choice([-2, -1, 0, 1, 2]) if not 60 <= i < 60 + r.choice([0, 14, 15, 40]) else 0
            a = r.choice([px + 500, 0, -3, 1 << 62, None]) if r.random() < 0.05 else px
            rows.append((r.randrange(3 * DAY) if r.random() < 0.05 else i * DAY // 100, sym, key, a, None if r.random() < 0.2 else px // 3))
    rows.append((None, "A", 9001, 5, None))
    rows.append((None, "A", 9002, 0, None))
    r.shuffle(rows)
    found = bad_readings([(ticks(spark, rows, "v0", "src", "kind"), "sym", "ts", "key", ["a", "b"])], chunk).collect()
    for k in (0, 1):
        assert {x.row_key for x in found if x.field == k} == plain_bad(rows, k)
    assert len(found) == len({(x.field, x.row_key) for x in found})


def test_bad_readings_without_rows_or_steps(spark):
    assert bad_readings([(ticks(spark, []), "sym", "ts", "key", ["a", "b"])]).count() == 0
    same = ticks(spark, [(i, "A", i, 7, None) for i in range(40)])
    assert bad_readings([(same, "sym", "ts", "key", ["a"])]).count() == 0
    two = [(ticks(spark, [(0, "A", 1, 0, 1)]), "sym", "ts", "key", ["a", "b"]), (ticks(spark, [(0, "A", 1, -5, 1)]), "sym", "ts", "key", ["a"])]
    assert sorted((r.tbl, r.field, r.row_key, r.impossible) for r in bad_readings(two).collect()) == [(0, 0, 1, True), (1, 0, 1, True)]


def test_trailing_totals(spark):
    us = lambda d: d * DAY + 5
    rows = [(us(0), "A", 1, 10, 0), (us(0), "A", 2, 5, 0), (us(8), "A", 3, 7, 0), (us(3), "B", 4, None, 0), (us(40), "B", 5, 2, 0), (us(50), None, 6, 99, 0), (None, "A", 7, 99, 0)]
    got = {(r.sym, (r.day - date(1970, 1, 1)).days): r for r in trailing_totals(ticks(spark, rows, "entity", "d"), "sym", "ts", "a").collect()}
    assert len(got) == 2 * 51
    assert (got["A", 0].sum_7d, got["A", 6].sum_7d, got["A", 7].sum_7d, got["A", 8].sum_7d, got["A", 8].sum_30d, got["A", 30].sum_30d, got["A", 38].sum_30d) == (15, 15, 0, 7, 22, 7, 0)
    assert got["A", 6].day_avg_7d == 15 / 7 and got["A", 6].avg_7d == 7.5 and got["A", 7].avg_7d is None and got["A", 7].day_avg_7d == 0
    assert got["B", 3].n_7d == 0 and got["B", 3].sum_7d == 0 and got["B", 50].sum_30d == 2
    assert trailing_totals(ticks(spark, []), "sym", "ts", "a").count() == 0


def test_per_key(spark):
    rows = [(1, "A", 1, 5, 9), (3, "A", 2, 5, None), (3, "A", 3, 8, None), (2, "A", 4, None, None), (1, None, 5, 1, (1 << 63) - 1), (1, None, 6, 2, (1 << 63) - 1), (None, "C", 7, 4, None)]
    got = {(r.sym, r.field): r for r in per_key(ticks(spark, rows, "key0", "at", "w"), "sym", "ts", ["a", "b"]).collect()}
    a = got["A", "a"]
    assert (a.rows, a["values"], a.distinct_values, a.lowest, a.highest, a.total, a["mode"], a.median, a.last_value) == (4, 3, 2, 5, 8, 18, 5, 5.0, 8)
    none = got[None, "a"]
    assert (none.rows, none.median, none["mode"]) == (2, 1.5, 1)
    assert got[None, "b"].total == 2 * ((1 << 63) - 1)
    empty = got["C", "b"]
    assert (empty.rows, empty["values"], empty.distinct_values, empty.lowest, empty.total, empty["mode"], empty.median, empty.last_value) == (1, 0, 0, None, None, None, None, None)
    assert got["C", "a"].last_value is None and got["C", "a"].median == 4
    assert per_key(ticks(spark, []), "sym", "ts", ["a"]).count() == 0


def test_one_copy_of_each(spark):
    rows = [(5, "x", 3, 1, 7), (4, "y", 2, 1, 7), (4, "y", 2, 1, 7), (1, "z", 1, 2, None), (1, "n", 9, None, 1), (1, "n", 9, None, 1), (1, None, None, 3, 1), (2, "late", 8, 3, 1)]
    df = ticks(spark, rows, "first_row", "delivery")
    kept = first_deliveries(df, "a", ["key"])
    assert kept.columns == df.columns
    assert sorted((r.a or 0, r.sym or "") for r in kept.collect()) == [(0, "n"), (0, "n"), (1, "y"), (2, "z"), (3, "late")]
    assert sorted(tuple(r) for r in surplus(df, "a", "key").collect()) == [(1, 3), (3, None)] and surplus(df, "a", "key").columns == ["a", "key"]
    lone = ticks(spark, [(1, "a", None, 4, 0), (1, "b", None, 4, 0), (1, "a", None, 5, 0), (1, "b", 1, 5, 0)])
    assert [tuple(r) for r in surplus(lone, "a", "key").collect()] == [(5, None)]  # copies without a delivery number alone are not told apart
    assert first_deliveries(ticks(spark, []), "a", ["key"]).count() == 0 and surplus(ticks(spark, []), "a", "key").count() == 0


def test_many_copies_of_one_key(spark):
    df = spark.range(20_000).select((F.col("id") % 3 * 0 + 1).alias("k"), F.col("id").alias("n"))
    assert [tuple(r) for r in first_deliveries(df, "k", ["n"]).collect()] == [(1, 0)]
    assert surplus(df, "k", "n").count() == 19_999


def test_day_is_utc(spark):
    at = datetime(2016, 1, 4, 23, 59, 59, tzinfo=timezone.utc)
    df = spark.createDataFrame([(at, "A", 1)], "ts timestamp, sym string, v int")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert trailing_totals(df, "sym", "ts", "v").select(F.col("day").cast("string")).first()[0] == "2016-01-04"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
