"""Runs, percentiles and nearest-time matching against plain Python, with every defined edge case."""

import math
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("batchloom.llm")

from batchloom.llm.nearest import nearest  # noqa: E402
from batchloom.llm.percentiles import Summary, combine, quantiles, summarise  # noqa: E402
from batchloom.llm.runs import collapse_runs  # noqa: E402

TOP = (1 << 63) - 1


def frame(spark, rows, *more):
    df = spark.createDataFrame(rows, "us bigint, e string, k bigint, a bigint, b bigint").withColumn("ts", F.timestamp_micros("us"))
    return df.select("*", *[F.lit(1).alias(c) for c in more])


def plain_runs(rows):
    by = {}
    for us, e, k, a, b in rows:
        if e is not None and us is not None and k is not None:
            by.setdefault(e, []).append((us, k, a, b))
    out = set()
    same = lambda x, y: (x is None and y is None) or (x is not None and y is not None and abs(x - y) <= 2)
    for e, s in by.items():
        s.sort(key=lambda r: r[:2])
        run = [s[0]]
        for prior, now in zip(s, s[1:] + [None]):
            if now and now[0] - prior[0] <= 60_000_000 and same(prior[2], now[2]) and same(prior[3], now[3]):
                run.append(now)
                continue
            if len(run) > 1:
                out.add((e, run[0][1], run[-1][1], len(run), (run[-1][0] - run[0][0]) / 1e6))
            run = [now]
    return out


@pytest.mark.parametrize("chunk", [1, 3, 50, 10**6])
def test_runs(spark, chunk):
    r = random.Random(chunk)
    rows = [(r.randrange(0, 4_000_000_000), r.choice(["A", "A", "A", "B", None]), k, r.choice([10, 11, 13, None, TOP, -TOP]), r.choice([5, 5, 6, None])) for k in range(300)]
    rows += [(5_000_000_000 + i, "C", 1000 + i, 1, 1) for i in range(120)] + [(None, "A", 7000, 1, 1), (1, "A", None, 1, 1), (6_000_000_000, "D", 8000, 1, 1)]
    got = collapse_runs(frame(spark, rows, "n", "left", "v0"), "e", "ts", "k", ["a", "b"], chunk_rows=chunk).collect()
    assert {(x.entity, x.first_key, x.last_key, x.n, x.seconds) for x in got} == plain_runs(rows)
    assert len(got) == len(plain_runs(rows))


def test_runs_of_nothing(spark):
    assert collapse_runs(frame(spark, []), "e", "ts", "k", ["a", "b"]).count() == 0


def test_nearest(spark):
    r = random.Random(5)
    left = [(r.randrange(0, 200_000_000), r.choice(["A", "A", "B", None]), k, 0, 0) for k in range(300)] + [(None, "A", 900, 0, 0)]
    right = [(r.randrange(0, 200_000_000), r.choice(["A", "A", "A", "B", None]), k, 0, 0) for k in range(400)]
    right += [(u, e, k + 1000, 0, 0) for u, e, k, _, _ in right[:100]] + [(None, "A", 5000, 0, 0), (1, "A", None, 0, 0)] + [(left[0][0] + d, left[0][1], 6000 + d, 0, 0) for d in (-7, 7)]
    left.append(left[0])  # a repeated row is matched on its own
    want = []
    for u, e, k, _, _ in left:
        near = [(abs(u - v), v, j) for v, f, j, _, _ in right if None not in (u, e, v, f, j) and e == f and abs(u - v) <= 1_000_000]
        if near:
            want.append((k, min(near)[2], min(near)[0]))
    for tick in (500_000, 1_000_000, 60_000_000):
        got = nearest(frame(spark, left, "side", "t"), frame(spark, right, "side", "tick").withColumnRenamed("k", "q"), "e", "ts", "k", "q", 1_000_000, tick)
        assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert nearest(frame(spark, []), frame(spark, right).withColumnRenamed("k", "q"), "e", "ts", "k", "q").count() == 0
    assert nearest(frame(spark, left), frame(spark, []).withColumnRenamed("k", "q"), "e", "ts", "k", "q").count() == 0


def rank_error(values, got, p):
    ranked = sorted(values)
    target = max(1, math.ceil(round(p * len(values), 9)))
    low = sum(v < got for v in ranked) + 1
    high = sum(v <= got for v in ranked)
    return 0 if low <= target <= high else min(abs(low - target), abs(high - target))


@pytest.mark.parametrize("kind", ["random", "sorted", "falling", "ties", "extremes"])
def test_summary_keeps_its_bound(kind):
    r = random.Random(1)
    values = [r.randrange(10**6) for _ in range(30_000)]
    values = {"random": values, "sorted": sorted(values), "falling": sorted(values)[::-1], "ties": [v % 7 for v in values], "extremes": [v if v % 9 else TOP for v in values]}[kind]
    import numpy as np

    from batchloom.llm.percentiles import quantile_values

    parts = []
    for a in range(0, len(values), 1700):
        s = Summary(128)
        s.add(np.array(values[a : a + 1700], np.int64))
        parts.append(s)
    whole = Summary(128)
    for s in parts:
        levels, sizes, vals = s.parts()
        whole.merge(s.n, s.under, s.over, levels, sizes, vals)
    levels, sizes, vals = whole.parts()
    assert whole.n == len(values) and sum((1 << max(0, x)) * n for x, n in zip(levels, sizes)) == len(values)
    assert 0 < whole.error < 0.03 * len(values)
    probabilities = [0.0, 0.01, 0.5, 0.9, 0.99, 0.999, 1.0]
    for p, q in zip(probabilities, quantile_values(levels, sizes, vals, whole.n, probabilities)):
        assert rank_error(values, q, p) <= whole.error


@pytest.mark.parametrize("epsilon, rows", [(1e-4, 10**9), (1e-2, 10**6), (0.5, 100)])
def test_buffer_size_keeps_the_stated_error(epsilon, rows):
    import numpy as np

    from batchloom.llm.percentiles import buffer_size

    size = buffer_size(epsilon, rows)
    assert np.log2(rows / size) / (4 * size) <= epsilon
    n = min(rows, 200_000)
    s = Summary(buffer_size(epsilon, n))
    s.add(np.random.default_rng(3).integers(0, 10**12, n))
    # One collapse on each level may stand without its counterpart.
    assert s.error <= epsilon * n + max(s.levels, default=0) + (1 << max(s.levels, default=0))


def test_percentiles_by_partition_and_day(spark):
    df = spark.range(0, 40_000, numPartitions=7).select((F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("day"), (F.xxhash64("id") % 100_000).alias("v"), F.lit(1).alias("n"), F.lit(2).alias("_lane"))
    df = df.select("*", F.when(F.col("g") == 2, None).otherwise(F.col("g")).alias("gg"))
    exact = {}
    for g, v in df.select("gg", "v").collect():
        exact.setdefault(g, []).append(v)
    direct = combine(summarise(df, ["gg"], "v", 256), ["gg"], 256, fan_in=2)
    daily = combine(combine(summarise(df, ["gg", "day"], "v", 256), ["gg", "day"], 256), ["gg"], 256, fan_in=2, per_key=5)
    for s in (direct, daily):
        rows = quantiles(s, ["gg"], [0.5, 0.9, 0.999]).collect()
        assert {r.gg for r in rows} == set(exact)
        for r in rows:
            assert r.n == len(exact[r.gg]) and 0 < r.error < 0.05 * r.n
            for p, q in zip([0.5, 0.9, 0.999], r.q):
                assert rank_error(exact[r.gg], q, p) <= r.error


def test_percentiles_of_little(spark):
    rows = frame(spark, [(0, "A", 1, None, 0), (0, "B", 2, 7, 0), (0, "C", 3, TOP, 0), (0, "C", 3, -TOP, 0)])
    got = {r.e: (r.n, r.error, list(r.q)) for r in quantiles(combine(summarise(rows, ["e"], "a"), ["e"]), ["e"], [0.5, 1.0]).collect()}
    assert got == {"B": (1, 0, [7, 7]), "C": (2, 0, [-TOP, TOP])}
    assert combine(summarise(frame(spark, []), ["e"], "a"), ["e"]).count() == 0
