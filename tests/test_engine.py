"""Batch assignment, zone maps, exchange form, feed, streams and the SQL route."""

import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from batchloom.functions.cycle import RollCycle
from batchloom.operators.asof import asof_join, bars, resolve_codes
from batchloom.operators.batching import by_byte_budget, by_row_count, first_end, model, next_starts, positions
from batchloom.operators.zonemap import survives, with_sealed, zone_map
from batchloom.sources.feed import backfill, market
from batchloom.sources.render import csv_header, csv_lines
from batchloom.sources.spec import TableSpec, column, quotes_spec, schema, trades_spec
from batchloom.sources.store import TableStore
from batchloom.streaming.sink import append_stream, append_two, status
from batchloom.streaming.windows import sessions, windowed

BASE = 1_700_000_000_000_000_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 5)), max_size=60), st.integers(1, 7), st.integers(0, 60))
def test_starts_follow_the_model(sizes, rows, cut):
    caps = [12, 7]
    want = [k for k, w in enumerate(model([(0, list(s)) for s in sizes], RollCycle(1440), rows, 10**9, caps)) if w[3] == 0]
    grid = np.array(sizes, np.int64).reshape(-1, 2)
    following, starts = next_starts(grid, caps, rows), [0] * bool(sizes)
    while starts and following[starts[-1]] < len(sizes):
        starts.append(int(following[starts[-1]]))
    assert starts == want
    open_at = max([k for k in want if k < cut], default=None)
    if open_at is not None and cut <= len(sizes):  # a batch that began before the rows at hand
        before = grid[open_at:cut]
        assert first_end(grid[cut:], caps, rows, len(before), before.sum(axis=0).tolist()) == min([k for k in want if k >= cut], default=len(sizes)) - cut


def test_positions_and_row_batches(spark):
    rows = [(k, k % 3 if k % 7 else None, (k * 37) % 1000) for k in range(1000)]
    df = spark.createDataFrame(rows, "id int, g int, o int").repartition(9)
    whole = [r.pos for r in positions(df, ["o", "id"]).orderBy("o", "id").collect()]
    assert whole == list(range(1000))
    for r in positions(df, ["o", "id"], ["g"]).groupBy("g").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect():
        assert r.p == list(range(len(r.p)))
    got = spark.range(20).select(*by_row_count(F.col("id"), 3, 2)).collect()
    assert [tuple(r) for r in got] == [(k // 6, k // 3 % 2, k % 3) for k in range(20)]
    assert positions(df.limit(0), ["o"]).count() == 0


def test_byte_budget_per_group(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["a", "b", None]), None if r.random() < 0.1 else "é" * r.randrange(9)) for k in range(3000)]
    got = by_byte_budget(spark.createDataFrame(rows, "id int, g string, s string").where("g IS NOT NULL"), ["id"], ["g"], {"s": 32}, 5).collect()
    for g in ("a", "b"):
        mine = [(k, s) for k, x, s in rows if x == g]
        want = model([(0, [2 * len(s or "")]) for _, s in mine], RollCycle(1440), 5, 10**9, [32])
        assert [x.batch for x in sorted(got) if x.g == g] == [w[2] for w in want]
    with pytest.raises(Exception, match="byte budget"):
        by_byte_budget(spark.createDataFrame(rows, "id int, g string, s string").where("g = 'a'"), ["id"], ["g"], {"s": 4}, 5).count()


@pytest.mark.parametrize("seed, block, carried", [(1, 8, False), (2, 512, True), (3, 1, True)])
def test_byte_budget_in_blocks(spark, monkeypatch, seed, block, carried):
    """Blocks far smaller than an interval, also after a batch that is open already."""
    from batchloom.operators import batching

    monkeypatch.setattr(batching, "SLICE_ROWS", 16)
    r = random.Random(seed)
    lengths = [[r.choice([0, 1, 3, 7, 16]) if r.random() > 0.3 else 0, r.randrange(5)] for _ in range(1500)]
    caps, rows = [16, 9], 6
    want = [(0, w[2]) for w in model([(0, x) for x in lengths], RollCycle(1440), rows, 10**9, caps)]
    first = 40 if carried else 0
    while carried and want[first][1] != want[first - 1][1]:  # cut inside a batch
        first += 1
    inside = [x for x, w in zip(lengths[:first], want) if w == want[first - 1]] if carried else []
    carry = (0, len(inside), [sum(c) for c in zip(*inside)]) if carried else None
    data = [(k, 0, "a" * a, "b" * b) for k, (a, b) in enumerate(lengths)][first:] + [(k, 1, "", "b") for k in range(40)]
    df = spark.createDataFrame(data, "id int, g int, s string, t string").repartition(7)
    got = {(x.g, x.id): x.batch for x in by_byte_budget(df, ["id"], ["g"], dict(s=16, t=9), rows, carry, block).collect()}
    assert len(got) == len(data)
    base = want[first][1] if carried else 0
    assert [got[0, k] for k in range(first, 1500)] == [w[1] - base for w in want[first:]]
    assert [got[1, k] for k in range(40)] == [k // rows for k in range(40)]


def test_pruning_never_loses_a_row(spark):
    r = random.Random(4)
    rows = [(k, r.randrange(100) if r.random() > 0.2 else None, r.randrange(50) if r.random() > 0.2 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, t bigint, s bigint").withColumn("batch", F.floor(F.col("k") / 8))
    zones = with_sealed(zone_map(df, ["batch"], "t", "s"), ["batch"]).cache()
    for _ in range(6):
        lo, hi = sorted((r.randrange(100), r.randrange(100)))
        kept = {x.batch for x in zones.where(survives((lo, hi), (10, 20))).collect()}
        assert {k // 8 for k, t, s in rows if t is not None and s is not None and lo <= t <= hi and 10 <= s <= 20} | {24} <= kept
    assert zones.where(survives()).count() == 25
    assert [x.sealed for x in zones.orderBy("batch").collect()] == [True] * 24 + [False]


ALL_TYPES = TableSpec.load(schema([
    column("ts", pa.timestamp("ns", "UTC")), column("flag", pa.bool_()), column("i8", pa.int8()), column("u16", pa.uint16()), column("i32", pa.int32()), column("i64", pa.int64()), column("f32", pa.float32()), column("f64", pa.float64()),
    column("dec", pa.decimal128(38, 9)), column("d32", pa.date32()), column("t64", pa.time64("ns")), column("fsb", pa.binary(16)), column("sym", pa.string(), varlen_bytes=64), column("bin", pa.binary(), varlen_bytes=64),
], table="all_types", schema_version=1, batch_rows=4, time_column="ts", stats_column="i64"))


def pattern(width, r):
    return bytes((r * width + i) % 256 for i in range(width))


def all_types_rows(n):
    from datetime import date, timedelta

    return [(BASE + r, r % 2 == 0, r, r * 7, r * 1000, r * 1_000_000, r + 0.5, r + 0.25, Decimal(r * 123456789).scaleb(-9), date(1970, 1, 1) + timedelta(19000 + r), r * 1000, bytearray(pattern(16, r)), f"s{r}", bytearray([r, r + 1])) for r in range(n)]


def rendered(store):
    rows = store.snapshot().scan()
    return [csv_header(store.spec)] + [r.line for r in csv_lines(rows, store.spec, ["segment", "batch", "row_pos"]).collect()]


def test_all_types_round_trip_as_text(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", ALL_TYPES, max_batches=2)
    df = spark.createDataFrame(all_types_rows(6), ALL_TYPES.spark_schema)
    store.append(df, ["ts"])
    assert [(b.row_count, b.sealed, b.ts_min, b.stat_max) for b in store.snapshot().batches().orderBy("batch").collect()] == [(4, True, BASE, 3_000_000), (2, False, BASE + 4, 5_000_000)]
    lines = rendered(store)
    # The expected text of the second row.
    assert lines[2] == '1700000000000000001,false,1,7,1000,1000000,1.5,1.25,0.123456789,19001,1000,101112131415161718191a1b1c1d1e1f,"s1",0102'
    assert len(lines) == 7 and lines[0].startswith("ts,flag,i8")


def test_nulls_empties_and_widths_as_text(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", ALL_TYPES)
    empty = tuple([BASE] + [None] * 4 + [0] + [None] * 6 + ["", bytearray()])
    store.append(spark.createDataFrame([tuple([BASE] + [None] * 4 + [0] + [None] * 8), empty, tuple([BASE + 1] + [None] * 4 + [1] + [None] * 6 + ['a"b', None])], ALL_TYPES.spark_schema), ["ts", "i64"])
    assert sorted(rendered(store)[1:]) == sorted(["1700000000000000000,,,,,0,,,,,,,,", '1700000000000000000,,,,,0,,,,,,,"",', '1700000000000000001,,,,,1,,,,,,,"a""b",'])
    with pytest.raises(Exception, match="not 16 bytes"):
        store.append(spark.createDataFrame([tuple([BASE] + [None] * 10 + [bytearray(15), None, None])], ALL_TYPES.spark_schema), ["ts"])
    with pytest.raises(Exception, match="(?i)overflow|out of range|CAST"):
        store.append(spark.createDataFrame([(BASE, 300)], "ts bigint, i8 int").select("*", *[F.lit(None).alias(c.name) for c in ALL_TYPES.columns if c.name not in ("ts", "i8")]), ["ts"])


def test_feed_invariants(spark):
    quotes, trades = market(spark, 5000, seed=3, symbols=4)
    again, _ = market(spark, 5000, seed=3, symbols=4)
    other, _ = market(spark, 5000, seed=4, symbols=4)
    q = quotes.orderBy("quote_id").collect()
    assert q == again.orderBy("quote_id").collect() != other.orderBy("quote_id").collect()
    assert all(0 < r.bid_px < r.ask_px and 700_000 < r.bid_px and r.ask_px < 1_300_000 for r in q)
    assert trades.count() == 500
    joined = trades.join(quotes.withColumnRenamed("quote_id", "trade_id").select(F.expr("trade_id + 1").alias("trade_id"), "bid_px", "ask_px"), "trade_id")
    assert joined.where("px NOT BETWEEN bid_px AND ask_px").count() == 0 and joined.count() == 500
    old, _ = backfill(spark, 3, 100, 10 * 86_400_000_000 + 5)
    assert old.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()[:] == (8 * 86_400_000_000, 11 * 86_400_000_000 - 864_000_000)


def test_asof_and_bars(spark):
    q = spark.createDataFrame([("A", 1, 1, 10), ("A", 5, 2, None), ("A", 5, 3, 30), ("B", 2, 4, 40), (None, 1, 5, 50)], "sym string, ts bigint, id int, bid int")
    t = spark.createDataFrame([("A", 0, 1), ("A", 1, 2), ("A", 9, 3), ("B", 9, 4), ("C", 9, 5)], "sym string, ts bigint, id int")
    got = asof_join(t, q.withColumnRenamed("id", "qid"), ["sym"], "ts", ["qid", "bid"], "qid").orderBy("id").collect()
    assert [(r.id, r.qid, r.bid) for r in got] == [(1, None, None), (2, 1, 10), (3, 3, 30), (4, 4, 40), (5, None, None)]
    trades = spark.createDataFrame([("A", 1, 10, 2), ("A", 3, 30, 1), ("A", 2, None, 9), ("A", 11, 5, None)], "sym string, ts bigint, px int, sz int")
    b = bars(trades, ["sym"], F.col("ts") - F.col("ts") % 10, ["ts"], "px", "sz").orderBy("interval_start").collect()
    assert b[0][:] == ("A", 0, 10, 30, 10, 30, 3, pytest.approx(50 / 3)) and b[1].volume is None and b[1].vwap is None
    names = spark.createDataFrame([(1, "one")], "k int, name string")
    assert {(r.id, r.name) for r in resolve_codes(t.select("id"), "id", names, "k").collect()} == {(1, "one"), (2, None), (3, None), (4, None), (5, None)}


def test_stream_into_store_and_liveness(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    quotes, trades = market(spark, 400, symbols=3)
    rows = quotes.select("quote_id", "ts", "sym", "bid_px", "ask_px", "bid_sz", "ask_sz", "venue")
    rows.where("quote_id < 200").coalesce(1).write.parquet(src)
    store = TableStore.create(spark, f"file://{tmp_path}/t", quotes_spec(64))
    run = lambda: append_stream(spark.readStream.schema(rows.schema).parquet(src), store, ["quote_id"], f"file://{tmp_path}/cp", "feed", once=True).awaitTermination()
    assert status(store, 1)["state"] == "NONE"
    run()
    first = store.snapshot()
    assert first.count() == 200 and store.epoch == 1
    rows.where("quote_id >= 200").coalesce(1).write.mode("append").parquet(src)
    run()
    assert store.snapshot().count() == 400 and first.count() == 200 and store.epoch == 2
    assert store.snapshot().scan().select("ts").distinct().count() == 400
    store.heartbeat(1_000_000)
    alive = status(store, 1.0, 1_500_000)
    assert alive["state"] == "ALIVE" and status(store, 1.0, 2_000_000)["state"] == "STALLED"
    store.heartbeat(2_000_000)
    assert status(store, 1.0, 2_100_000, since=alive)["state"] == "STUCK"


def test_one_stream_into_two_tables(spark, tmp_path):
    quotes, _ = market(spark, 60, symbols=2)
    mixed = quotes.select(F.col("quote_id").alias("n"), "ts", "sym", "bid_px", "ask_px", "bid_sz", "ask_sz", "venue", F.col("bid_px").alias("px"), F.col("bid_sz").alias("sz"), F.lit("B").alias("side"), F.col("quote_id").alias("trade_id"))
    mixed.coalesce(1).write.parquet(f"file://{tmp_path}/src")
    a, b = TableStore.create(spark, f"file://{tmp_path}/q", quotes_spec(16)), TableStore.create(spark, f"file://{tmp_path}/t", trades_spec(16))
    b.append(mixed.where("n = 59"), ["n"])
    append_two(spark.readStream.schema(mixed.schema).parquet(f"file://{tmp_path}/src"), [(a, "n % 10 <> 9", ["n"]), (b, "n % 10 = 9", ["n"])], f"file://{tmp_path}/cp", "both", once=True).awaitTermination()
    assert (a.snapshot().count(), b.snapshot().count()) == (54, 7) and a.snapshot().latest_epoch() == b.snapshot().latest_epoch() == 2


def test_sql_route_pushes_filters(spark, tmp_path):
    from batchloom.sources.datasource import PruningReader, register

    store = TableStore.create(spark, f"file://{tmp_path}/t", quotes_spec(64), max_batches=1)
    quotes, _ = market(spark, 300, symbols=3, step_us=40_000_000_000)
    store.append(quotes, ["quote_id"])
    register(spark)
    df = spark.read.format("batchloom").option("path", f"file://{tmp_path}/t").load()
    assert df.count() == 300 and sorted(df.columns) == sorted(c.name for c in quotes_spec().columns)
    px = quotes.agg(F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY bid_px)")).first()[0]
    assert df.where(F.col("bid_px") <= px).count() == quotes.where(F.col("bid_px") <= px).count()
    middle = quotes.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(ts))").cast("bigint")).first()[0]
    early = F.unix_micros("ts") <= middle
    assert df.where(F.col("ts") <= F.timestamp_micros(F.lit(middle))).count() == quotes.where(early).count()
    reader = PruningReader(str(tmp_path / "t"), store.spec, store.spec.spark_schema)
    everything = len(reader.partitions())
    reader.bounds = {"bid_px": [None, -1]}
    assert everything > 1 and reader.partitions() == []
    reader.bounds = {"ts": [None, middle]}
    assert 0 < len(reader.partitions()) < everything
    # Detached and tombstoned segments are as invisible here as in snapshots.
    ids = [r.segment_id for r in store.snapshot().segments().orderBy("segment_id").collect()]
    store.detach(ids[len(ids) // 2])
    again = spark.read.format("batchloom").option("path", f"file://{tmp_path}/t").load()
    assert 0 < again.count() == store.snapshot().count() < 300
    store.reattach()
    store.retain(2)
    assert spark.read.format("batchloom").option("path", f"file://{tmp_path}/t").load().count() == store.snapshot().count() < 300
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    plain = spark.read.format("batchloom").option("path", f"file://{tmp_path}/t").option("pushdown", "false").load()
    assert plain.where("bid_px > 0").count() == store.snapshot().count()


def test_windows(spark):
    df = spark.createDataFrame([(0, "a"), (50, "a"), (61, "a"), (400, "a"), (None, "b")], "s bigint, k string").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.rows for r in windowed(df, "ts", ["k"], "1 minute").collect()) == [1, 1, 2]
    assert sorted(r.rows for r in windowed(df, "ts", ["k"], "2 minutes", "1 minute").collect()) == [1, 1, 1, 2, 3]
    assert sorted(r.rows for r in sessions(df, "ts", ["k"], "2 minutes").collect()) == [1, 3]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert isinstance(entry.entry(spark).schema, T.StructType)


def test_command_line(spark, tmp_path, capsys):
    from batchloom.__main__ import main

    main(["backfill", f"file://{tmp_path}", "--days", "2", "--events", "200", "--cycle", "1d", "--batch-rows", "64"])
    out = capsys.readouterr().out
    assert "quotes 400 rows" in out and "trades 40 rows" in out
    store = TableStore(spark, f"file://{tmp_path}/quotes")
    assert all(r.sealed for r in store.snapshot().batches().collect())
    inside = store.snapshot().segments().select((F.col("ts_min") >= F.col("interval_start")) & (F.col("ts_max") < F.col("interval_start") + 86_400_000_000))
    assert [r[0] for r in inside.collect()] == [True, True]
