"""Queries for the engine's own operators on the driver's tables, with their SQL.

``events`` plays the feed: it arrives in the order of event_id, its time is ts, its stats column user_id, its symbol
event_type and its variable-length column props. Batches hold 256 rows and segments 8 batches, unless a query says
otherwise.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import values as V
from ..functions.cycle import MINUTE_US, RollCycle
from ..functions.names import id_column, id_parts, name_column, name_parts
from ..functions.timeexpr import micros
from ..operators.asof import asof_join, bars, resolve_codes
from ..operators.batching import by_byte_budget, by_row_count, positions
from ..operators.zonemap import null_counts, with_sealed, zone_map
from ..sources.feed import BAND, BASE_PX, backfill, market
from ..sources.render import cell
from ..sources.spec import TableSpec, column, physical_kind, quotes_spec, schema, spark_type, trades_spec
from ..sources.store import TableStore
from ..staging import scratch
from ..streaming.windows import sessions, windowed
from ..tables import table

ROWS, BATCHES, BUDGET = 256, 8, 2048
CYCLE = RollCycle.parse("4h")


def _events(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    px = F.round(F.col("value") * 10000).cast("bigint").alias("px")
    return e.select("event_id", micros("ts", e.schema["ts"].dataType).alias("ts"), "user_id", "event_type", "props", px)


def _batched(spark: SparkSession, base: str, *extra: str) -> DataFrame:
    e = positions(_events(spark, base).select("event_id", "ts", "user_id", *extra), ["event_id"])
    seq, batch, row = by_row_count(F.col("pos"), ROWS, BATCHES)
    return e.select("*", seq.alias("segment_seq"), batch.alias("batch"), row.alias("row"))


def _rotated(spark: SparkSession, base: str) -> DataFrame:
    e = _events(spark, base).select("event_id", "ts", "user_id", CYCLE.floor_column(F.col("ts")).alias("interval_start"))
    e = positions(e, ["event_id"], ["interval_start"])
    seq, batch, _ = by_row_count(F.col("pos"), ROWS, BATCHES)
    return e.select("*", seq.alias("segment_seq"), batch.alias("batch"))


def _zones(spark: SparkSession, base: str) -> DataFrame:
    """Zone map by batch number over the whole feed, the last batch in progress."""
    e = positions(_events(spark, base).select("event_id", "ts", "user_id"), ["event_id"])
    z = zone_map(e.withColumn("batch", F.floor(F.col("pos") / ROWS)), ["batch"], "ts", "user_id")
    return with_sealed(z, ["batch"])


def _arrivals(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    return e.select(F.timestamp_micros(micros("ts", e.schema["ts"].dataType)).alias("ts"), "event_id", "user_id", "event_type", "props")


def feed_spec(batch_rows: int = ROWS) -> TableSpec:
    ts = pa.timestamp("us", "UTC")
    columns = [column("ts", ts, sort_key=0), column("event_id", pa.int64()), column("user_id", pa.int64()), column("event_type", pa.string(), varlen_bytes=batch_rows * 64), column("props", pa.string(), varlen_bytes=batch_rows * 64)]
    return TableSpec.load(schema(columns, table="feed", schema_version=1, batch_rows=batch_rows, time_column="ts", stats_column="user_id"))


_feeds: dict[tuple, TableStore] = {}


def _feed(spark: SparkSession, base: str, rotated: bool = False) -> TableStore:
    """The whole feed in a store, written once per session: in one segment (all rows arrive in one interval) or, by event
    time, in intervals of four hours. Queries read its first version and never depend on what others committed later."""
    key = (spark.sparkContext.applicationId, base, rotated)
    if key not in _feeds:
        e = _arrivals(spark, base)
        options = {"cycle": "4h", "max_batches": BATCHES} if rotated else {"max_batches": 1 << 40, "rotation_time": "processing"}
        store = TableStore.create(spark, scratch(spark, "feed"), feed_spec(), **options)
        store.append(e, ["event_id"], now_us=0)
        _feeds[key] = store
    return _feeds[key]


def _segments(spark: SparkSession, base: str) -> DataFrame:
    """The segments that the feed makes: start minute, cycle, sequence, rows."""
    r = _rotated(spark, base).groupBy("interval_start", "segment_seq").agg(F.count(F.lit(1)).alias("row_count"))
    return r.select(F.floor(F.col("interval_start") / MINUTE_US).alias("start_minute"), F.lit(CYCLE.minutes).alias("cycle"), "segment_seq", "row_count")


def g8_symbol_agg(spark, base):
    return table(spark, base, "quotes").groupBy("sym").agg(F.count(F.lit(1)).alias("n"), V.scaled_price(F.max("ask_px")).alias("max_ask"))


def g8_live_symbols(spark, base):
    return table(spark, base, "live_quotes").groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.min("px").alias("low"), F.max("px").alias("high"))


def f1_batch_rowcount(spark, base):
    return _batched(spark, base).groupBy("segment_seq", "batch").agg(F.count(F.lit(1)).alias("row_count"))


def g1_g2_zone_map(spark, base):
    return _zones(spark, base).select("batch", "row_count", "ts_min", "ts_max", "stat_min", "stat_max")


def f3_segment_seq(spark, base):
    return _batched(spark, base).groupBy("segment_seq").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("batch").alias("batches"))


def f4_interval_floor(spark, base):
    e = _events(spark, base)
    return e.groupBy(CYCLE.floor_column(F.col("ts")).alias("interval_start"), CYCLE.end_column(F.col("ts")).alias("interval_end")).agg(F.count(F.lit(1)).alias("n"))


def f4_f3_rotation(spark, base):
    return _rotated(spark, base).groupBy("interval_start", "segment_seq", "batch").agg(F.count(F.lit(1)).alias("row_count"))


def f2_varlen_budget(spark, base):
    e = _events(spark, base).select("event_id", "props", F.lit(0).alias("feed"))
    placed = by_byte_budget(e, ["event_id"], ["feed"], {"props": BUDGET}, ROWS)
    return placed.groupBy("batch").agg(F.count(F.lit(1)).alias("row_count"), F.min("event_id").alias("first_id"), F.coalesce(F.sum(F.octet_length("props")), F.lit(0)).cast("bigint").alias("bytes"))


def f1_lazy_seal(spark, base):
    z = _zones(spark, base)
    return z.select("batch", "sealed", (F.col("row_count") > 0).alias("sealed_finally"))


def f8_row_by_position(spark, base):
    return _batched(spark, base).where("batch = 3 AND row = 17").select("segment_seq", "event_id")


STAT_RANGE = (100, 140)


def _ranges(spark, base, by_time: bool, by_stat: bool) -> tuple:
    """The closed range from the 20th to the 25th per cent of the feed's time span, and STAT_RANGE."""
    span = None
    if by_time:
        lo, hi = _events(spark, base).agg(F.min("ts"), F.max("ts")).first()
        span = (lo + (hi - lo) * 20 // 100, lo + (hi - lo) * 25 // 100)
    return span, STAT_RANGE if by_stat else None


def _pruned(spark, base, by_time: bool, by_stat: bool):
    return _feed(spark, base).snapshot(1).prune(*_ranges(spark, base, by_time, by_stat)).select("batch", "sealed")


def prune_time(spark, base):
    return _pruned(spark, base, True, False)


def prune_stat(spark, base):
    return _pruned(spark, base, False, True)


def prune_both(spark, base):
    return _pruned(spark, base, True, True)


def prune_none(spark, base):
    return _pruned(spark, base, False, False)


def prune_detached(spark, base):
    """Segments above the detach watermark, here the id of the third interval's first segment."""
    store = _feed(spark, base, True)
    third = store.snapshot(1).segments().where("seq = 0").orderBy("segment_id").offset(2).first()["segment_id"]
    return store.snapshot(store.detach(third)).segments().select(F.col("segment_id").alias("id"), "row_count")


def sql_route_detached(spark, base):
    """Rows per segment that plain SQL sees of a table whose first days are detached."""
    from ..sources.datasource import register

    register(spark)
    store = TableStore.create(spark, scratch(spark, "route"), feed_spec(), cycle="1d")
    store.append(_arrivals(spark, base), ["event_id"])
    store.detach(store.snapshot().segments().orderBy("segment_id").offset(2).first()["segment_id"])
    spark.read.format("batchloom").option("path", store.path).load().createOrReplaceTempView("batchloom_feed")
    return spark.sql("SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM batchloom_feed WHERE user_id >= 100 GROUP BY event_type")


def scan_both(spark, base):
    """Rows of a scan by both ranges: batches are pruned, rows filtered."""
    return _feed(spark, base).snapshot(1).scan(*_ranges(spark, base, True, True)).select("event_id", "user_id", "batch", "row_pos")


def b3_versions(spark, base):
    """Rows that each of three versions of a growing table shows (batch by batch a prefix of the next)."""
    e = _arrivals(spark, base)
    store = TableStore.create(spark, scratch(spark, "versions"), feed_spec(), rotation_time="processing", max_batches=1 << 40)
    for part in ("event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"):
        store.append(e.where(part), ["event_id"], now_us=0)
    views = [store.snapshot(v).batches().agg(F.lit(v).alias("version"), F.sum("row_count").alias("n"), F.count_if("sealed").alias("sealed"), F.max("ts_max").alias("ts_max")) for v in (1, 2, 3)]
    return views[0].unionAll(views[1]).unionAll(views[2])


def c13_empty_batches(spark, base):
    """A batch sealed without rows, one with all rows of the feed's first user, and the empty one that sealing opens."""
    e = _arrivals(spark, base)
    store = TableStore.create(spark, scratch(spark, "empty"), feed_spec(1 << 20), rotation_time="processing")
    store.seal(now_us=0)
    store.append(e, ["event_id"], now_us=0)
    store.seal()
    return store.snapshot().batches().select("batch", "row_count", "sealed", "ts_min")


def b16_feed(spark, base):
    """Invariants of the synthetic market: spreads, prices of trades, ids, band."""
    quotes, trades = market(spark, 10_000, seed=5, symbols=20)
    met = asof_join(trades, quotes, ["sym"], "ts", ["bid_px", "ask_px"], "quote_id")
    off = met.agg(F.count(F.lit(1)).alias("trades"), F.count_if(~F.col("px").isin([F.col("bid_px"), F.col("ask_px")])).alias("off_market"), F.count_distinct("trade_id").alias("ids"))
    wrong = quotes.agg(F.count(F.lit(1)).alias("quotes"), F.count_if((F.col("bid_px") <= 0) | (F.col("ask_px") <= F.col("bid_px"))).alias("crossed"), F.count_if(F.abs(F.col("bid_px") + F.col("ask_px") - 2 * BASE_PX) > 2 * BAND).alias("out_of_band"))
    return wrong.withColumn("one", F.lit(1)).join(off.withColumn("one", F.lit(1)), "one").drop("one")


def c18_backfill(spark, base):
    """Three completed days of the synthetic market in two tables that share an epoch: all sealed, all inside their day."""
    out = None
    for name, df, kind, order in zip(("quotes", "trades"), backfill(spark, 3, 2_000, 20_000 * 86_400_000_000, seed=2), (quotes_spec(512), trades_spec(512)), ("quote_id", "trade_id")):
        store = TableStore.create(spark, scratch(spark, name), kind, cycle="1d")
        store.append(df, [order])
        store.close()
        s = store.snapshot().segments().select(F.lit(name).alias("tbl"), "interval_start", "row_count", "batches", ((F.col("ts_min") >= F.col("interval_start")) & (F.col("ts_max") < F.col("interval_start") + 86_400_000_000)).alias("inside"), "epoch")
        out = s if out is None else out.unionAll(s)
    return out


def r15_cycles(spark, base):
    """Intervals of the feed under several roll cycles."""
    e = _events(spark, base).select("ts")
    out = None
    for text in ("30m", "4h", "6h", "1d"):
        c = RollCycle.parse(text)
        part = e.groupBy(c.floor_column(F.col("ts")).alias("interval_start"), c.end_column(F.col("ts")).alias("interval_end")).agg(F.count(F.lit(1)).alias("n")).withColumn("cycle", F.lit(c.minutes))
        out = part if out is None else out.unionAll(part)
    return out


def r17_pinned_reader(spark, base):
    """Rows that a reader sees who opened the table before all but three of its segments were removed, and one after."""
    store = TableStore.create(spark, scratch(spark, "pinned"), feed_spec(), cycle="1d")
    store.append(_arrivals(spark, base), ["event_id"])
    before = store.snapshot()
    store.retain(3)
    seen = lambda which, snap: snap.scan().agg(F.lit(which).alias("reader"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    return seen("before", before).unionAll(seen("after", store.snapshot()))


def s6_idle_rotation(spark, base):
    """A heartbeat after the interval's end seals its batch, though no row arrives; the next rows open a new segment."""
    store = TableStore.create(spark, scratch(spark, "idle"), feed_spec(1 << 20), cycle="4h", rotation_time="processing")
    e = _arrivals(spark, base)
    store.append(e.where("event_id % 2 = 0"), ["event_id"], now_us=1)
    store.heartbeat(CYCLE.micros - 1)
    early = store.snapshot()
    store.heartbeat(CYCLE.micros)
    late = store.snapshot()
    store.append(e.where("event_id % 2 = 1"), ["event_id"], now_us=CYCLE.micros + 5)
    views = [(i, snap.batches()) for i, snap in enumerate((early, late, store.snapshot()))]
    shown = [b.select(F.lit(i).alias("moment"), F.floor(F.col("interval_start") / MINUTE_US).alias("start_minute"), "row_count", "sealed") for i, b in views]
    return shown[0].unionAll(shown[1]).unionAll(shown[2])


def c9_varlen_store(spark, base):
    """Batches of a store whose byte budget, not its row count, closes them."""
    columns = [column("ts", pa.timestamp("us", "UTC")), column("event_id", pa.int64()), column("props", pa.string(), varlen_bytes=BUDGET)]
    spec = TableSpec.load(schema(columns, table="feed", schema_version=1, batch_rows=ROWS, time_column="ts", stats_column="event_id"))
    store = TableStore.create(spark, scratch(spark, "budget"), spec, rotation_time="processing", max_batches=1 << 40)
    store.append(_arrivals(spark, base), ["event_id"], now_us=0)
    return store.snapshot().batches().select("batch", "row_count", F.col("stat_min").cast("bigint").alias("first_id"))


def _quote_store(spark: SparkSession, base: str) -> TableStore:
    store = TableStore.create(spark, scratch(spark, "quotes"), quotes_spec(8192), cycle="1d", max_batches=16)
    store.append(table(spark, base, "quotes"), ["quote_id"])
    return store


def store_range_scan(spark, base):
    """Ingest quotes, then scan one day and a price range through the zone map."""
    snap = _quote_store(spark, base).snapshot()
    first = 1_452_470_400_000_000  # 2016-01-11
    return snap.scan((first, first + 86_400_000_000 - 1), (100_000, 900_000)).select("ts", "sym", "bid_px", "ask_px", "bid_sz", "ask_sz", "venue")


def store_catalog(spark, base):
    """The catalog of the ingested quotes: one row per batch."""
    store = _quote_store(spark, base)
    store.close()
    return store.snapshot().batches().select("interval_start", "seq", "batch", "row_count", "ts_min", "ts_max", F.col("stat_min").cast("bigint").alias("stat_min"), F.col("stat_max").cast("bigint").alias("stat_max"), "sealed")


def r18_encode_id(spark, base):
    s = _segments(spark, base)
    return s.select("start_minute", "segment_seq", id_column(F.col("start_minute"), F.col("cycle"), F.col("segment_seq")).alias("id"))


def r18_decode_id(spark, base):
    s = _segments(spark, base).select(id_column(F.col("start_minute"), F.col("cycle"), F.col("segment_seq")).alias("id"))
    start, cycle, seq = id_parts(F.col("id"))
    return s.select("id", start.alias("start_minute"), cycle.alias("cycle"), seq.alias("seq"))


def r7_segment_name(spark, base):
    s = _segments(spark, base)
    return s.select(name_column(F.col("start_minute"), F.col("cycle"), F.col("segment_seq")).alias("name"), "row_count")


def r8_parse_name(spark, base):
    s = _segments(spark, base).select(name_column(F.col("start_minute"), F.col("cycle"), F.col("segment_seq")).alias("name"))
    start, cycle, seq = name_parts(F.col("name"))
    return s.select("name", start.alias("start_minute"), cycle.alias("cycle"), seq.alias("seq"))


def r9_listing_order(spark, base):
    s = _feed(spark, base, True).snapshot(1).segments()
    s = positions(s.select("interval_start", "cycle", "seq"), ["interval_start", "cycle", "seq"])
    return s.select((F.col("pos") + 1).alias("place"), F.floor(F.col("interval_start") / MINUTE_US).alias("start_minute"), F.col("seq").cast("bigint").alias("segment_seq"))


def r10_next_seq(spark, base):
    return _segments(spark, base).groupBy("start_minute", "cycle").agg((F.max("segment_seq") + 1).alias("next_seq"))


def r11_latest_epoch(spark, base):
    """Three writers, the last of which brings late rows: the latest epoch is that of the last segment by name."""
    e = _arrivals(spark, base)
    store = TableStore.create(spark, scratch(spark, "epochs"), feed_spec(), cycle="1d")
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    for part in (day % 3 == 0, day % 3 == 2, day % 3 == 1):
        store.open_writer()
        store.append(e.where(part), ["event_id"])
    return store.snapshot().segments().agg(F.max("epoch").alias("largest")).withColumn("latest", F.lit(store.snapshot().latest_epoch()).cast("bigint"))


def r12_interval_end(spark, base):
    s = _segments(spark, base)
    return s.select("start_minute", "segment_seq", (F.col("start_minute") + F.col("cycle")).alias("end_minute"), F.date_from_unix_date(F.floor(F.col("start_minute") / 1440).cast("int")).alias("day"))


def r16_retention(spark, base):
    """What is left of the feed's segments when the newest five are retained."""
    e = _arrivals(spark, base)
    store = TableStore.create(spark, scratch(spark, "retained"), feed_spec(), cycle="4h", max_batches=BATCHES)
    store.append(e, ["event_id"])
    store.retain(5)
    store.vacuum(0)
    rows = store.snapshot().scan().groupBy("segment").agg(F.count(F.lit(1)).alias("row_count"))
    start, _, seq = id_parts(F.col("segment"))
    return rows.select(start.alias("start_minute"), seq.alias("segment_seq"), "row_count")


def r19_civil_days(spark, base):
    o = table(spark, base, "orders")
    d = o.select(F.floor(micros("o_orderdate", o.schema["o_orderdate"].dataType) / 86_400_000_000).cast("int").alias("days")).groupBy("days").agg(F.count(F.lit(1)).alias("n"))
    date = F.date_from_unix_date("days")
    return d.select("days", F.year(date).alias("y"), F.month(date).alias("m"), F.day(date).alias("d"), F.unix_date(F.make_date(F.year(date), F.month(date), F.day(date))).alias("back"), "n")


def g4_in_progress_rows(spark, base):
    z = _feed(spark, base).snapshot(1).batches()
    return z.where("NOT sealed").agg(F.max_by("row_count", "batch").alias("open_rows"), F.count(F.lit(1)).alias("open_batches"))


def g5_g6_coverage(spark, base):
    s = _feed(spark, base, True).snapshot(1).segments().select("interval_start", F.col("seq").cast("bigint").alias("segment_seq"), "row_count", "ts_min", "ts_max")
    inside = (F.col("ts_min") >= F.col("interval_start")) & (F.col("ts_max") < F.col("interval_start") + CYCLE.micros)
    return s.withColumn("inside", inside)


def b5_null_counts(spark, base):
    t = table(spark, base, "all_types")
    return null_counts(t.withColumn("day", F.floor(micros("ts", t.schema["ts"].dataType) / 86_400_000_000)), ["day"], ["flag", "i8", "u16", "i32", "i64", "f32", "f64", "dec38", "d32", "t64", "fsb", "sym", "bin"])


def b15_cells(spark, base):
    """Exchange form of the types whose text does not depend on a language's float printing."""
    return table(spark, base, "all_types").select(*[cell(name, kind).alias(name) for name, kind in _ALL_TYPES.items() if name not in ("f32", "f64")])


def b15_floats(spark, base):
    """Exchange form of floats, read back: the shortest text that gives the same number."""
    t = table(spark, base, "all_types").where("f64 IS NOT NULL AND f32 IS NOT NULL")
    shown = t.select("f64", "f32", cell("f64", pa.float64()).alias("text64"), cell("f32", pa.float32()).alias("text32"))
    same = lambda a, b: a.eqNullSafe(b)
    return shown.agg(F.count(F.lit(1)).alias("n"), F.count_if(same(F.col("text64").cast("double"), F.col("f64"))).alias("same64"), F.count_if(same(F.col("text32").cast("float"), F.col("f32"))).alias("same32"))


_ALL_TYPES = {"ts": pa.timestamp("us", "UTC"), "flag": pa.bool_(), "i8": pa.int8(), "u16": pa.uint16(), "i32": pa.int32(), "i64": pa.int64(), "f32": pa.float32(), "f64": pa.float64(), "dec38": pa.decimal128(38, 9), "d32": pa.date32(), "t64": pa.time64("ns"), "fsb": pa.binary(16), "sym": pa.string(), "bin": pa.binary()}


def c4_all_types(spark, base):
    """Every accepted type, nulls, extremes, NaN and empty values through a store and back."""
    budget = {"varlen_bytes": 1 << 26}
    columns = [column(n, t, **(budget if n in ("sym", "bin") else {})) for n, t in _ALL_TYPES.items()]
    spec = TableSpec.load(schema(columns, table="all_types", schema_version=1, batch_rows=512, time_column="ts", stats_column="i64"))
    store = TableStore.create(spark, scratch(spark, "all-types"), spec, cycle="1d")
    store.append(table(spark, base, "all_types"), ["ts", "i64", "t64"], now_us=0)
    rows = store.snapshot().scan()
    kind = lambda c: F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(F.col(c) > 0, "inf").otherwise("-inf")).when(F.col(c).isNotNull(), "finite").alias(f"{c}_kind")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double") + F.lit(0.0)).alias(c)
    plain = [n for n in _ALL_TYPES if n not in ("f32", "f64", "fsb", "bin")]
    return rows.select(*plain, kind("f32"), finite("f32"), kind("f64"), finite("f64"), V.hex_lower(F.col("fsb")).alias("fsb"), V.hex_lower(F.col("bin")).alias("bin"))


def c17_two_tables(spark, base):
    """One stream of trades into two stores by side, which share an epoch; rows and epoch of each."""
    from ..streaming.sink import append_two

    source = table(spark, base, "trades")
    stream = spark.readStream.schema(source.schema).option("recursiveFileLookup", "true").parquet(f"{base}/trades*.parquet")
    root = scratch(spark, "two")
    stores = {name: TableStore.create(spark, f"{root}/{name}", trades_spec(1 << 16), cycle="1d") for name in ("buys", "others")}
    stores["others"].open_writer()
    stores["others"].detach(0)  # a commit of a writer before this one, which hides nothing
    buys = "upper(side) = 'B'"
    routes = [(stores["buys"], buys, ["row_id"]), (stores["others"], f"NOT coalesce({buys}, false)", ["row_id"])]
    append_two(stream, routes, f"{root}/checkpoint", f"two-{uuid.uuid4().hex}", once=True).awaitTermination()
    one = lambda name: stores[name].snapshot().batches().agg(F.lit(name).alias("tbl"), F.sum("row_count").alias("n"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))
    return one("buys").unionAll(one("others"))


def a2_types(spark, base):
    """Physical kind and width of every column type that a table of all types uses, and what stores it."""
    rows = [(n, *physical_kind(t), spark_type(t).simpleString()) for n, t in _ALL_TYPES.items()]
    return spark.createDataFrame(rows, "name string, kind string, width int, stored string")


def a7_layout(spark, base):
    """Buffers of a batch of trades: offsets aligned to 64 bytes, none overlapping; the batch in whole pages."""
    spec = trades_spec(1000)
    rows = [(i, r["column"], r["validity"], r["offsets"], r["data"], r["capacity"]) for i, r in enumerate(spec.batch_layout())]
    return spark.createDataFrame(rows, "place int, name string, validity bigint, offsets bigint, data bigint, capacity bigint").withColumn("batch_bytes", F.lit(spec.batch_bytes).cast("bigint"))


def r14_cycles(spark, base):
    """Roll cycles as text: minutes, or null where the text is none that divides a day."""
    def minutes(text: str) -> int | None:
        try:
            return RollCycle.parse(text).minutes
        except ValueError:
            return None

    texts = ["1m", "30m", "45m", "4h", "6h", "7h", "24h", "25h", "1d", "2d", "0m", "90s", "4x", "h", "", "1440m"]
    return spark.createDataFrame([(t, minutes(t)) for t in texts], "cycle string, minutes int")


def x1_x2_length_bits(spark, base):
    z = _zones(spark, base).withColumn("word", V.length_word(F.col("row_count"), F.col("sealed")))
    return z.select("batch", "word", V.row_count(F.col("word")).alias("rows"), V.in_progress(F.col("word")).alias("in_progress"))


def x3_layout_bytes(spark, base):
    q = table(spark, base, "all_types").select("u16").where("u16 IS NOT NULL").groupBy("u16").agg(F.count(F.lit(1)).alias("n"))
    return q.select("u16", "n", V.align(F.col("u16"), 64).alias("aligned"), V.align(F.col("u16"), V.PAGE).alias("paged"), V.bitmap_bytes(F.col("u16")).alias("bitmap"))


def x4_sha256(spark, base):
    return table(spark, base, "events").select("event_id", F.sha2("props", 256).alias("digest"))


def x10_price(spark, base):
    return table(spark, base, "trades").select("row_id", V.scaled_price(F.col("px")).alias("price"))


def x11_decimal_halves(spark, base):
    t = table(spark, base, "all_types").where("i64 IS NOT NULL AND i32 IS NOT NULL AND i8 IS NOT NULL")
    return t.select("i64", "i8", V.decimal_from_halves(F.col("i64"), F.col("i8").cast("bigint"), 9).alias("dec"))


def x12_unsigned(spark, base):
    t = table(spark, base, "all_types")
    return t.select("i8", "i32", "i64", V.unsigned(F.col("i8"), 8).alias("u8"), V.unsigned(F.col("i32"), 32).alias("u32"), V.unsigned(F.col("i64"), 64).alias("u64"))


def x13_hex(spark, base):
    return table(spark, base, "all_types").select(V.hex_lower(F.col("fsb")).alias("fsb"), V.hex_lower(F.col("bin")).alias("bin"), V.quoted(F.col("sym")).alias("sym"))


def x14_overlap(spark, base):
    z = _zones(spark, base)
    return z.select("batch", V.overlaps(F.col("stat_min"), F.col("stat_max"), 100, 140).alias("meets"))


def s3_snapshot_freeze(spark, base):
    """A snapshot taken before the second of two commits keeps its count."""
    q = table(spark, base, "live_quotes").withColumn("ask_px", F.col("px")).withColumnRenamed("px", "bid_px")
    q = q.select("ts", "sym", "bid_px", "ask_px", F.lit(1).alias("bid_sz"), F.lit(1).alias("ask_sz"), F.lit("X").alias("venue"))
    store = TableStore.create(spark, scratch(spark, "live"), quotes_spec(1024), cycle="1d")
    store.append(q.where("sym < 'N'"), ["ts", "sym", "bid_px"])
    frozen = store.snapshot()
    store.append(q.where("sym >= 'N' OR sym IS NULL"), ["ts", "sym", "bid_px"])
    one = lambda which, snap: snap.batches().agg(F.lit(which).alias("view"), F.sum("row_count").alias("n"))
    return one("frozen", frozen).unionAll(one("now", store.snapshot()))


def s7_liveness(spark, base):
    """Gaps between a symbol's quotes within a day; 60 seconds and more are a stall (of a writer: ``s7_states``)."""
    q = table(spark, base, "quotes").where("sym IS NOT NULL").select("sym", "quote_id", micros("ts").alias("t"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("sym", F.floor(F.col("t") / 86_400_000_000)).orderBy("t", "quote_id"))
    g = q.select("sym", gap.alias("gap"))
    return g.groupBy("sym").agg(F.count_if(F.col("gap") >= 60_000_000).alias("stalls"), F.max("gap").alias("longest"))


def s7_states(spark, base):
    """States of a writer of all live quotes, by the time since its last heartbeat and what it has done since."""
    from ..streaming.sink import status

    q = table(spark, base, "live_quotes").withColumn("ask_px", F.col("px")).withColumnRenamed("px", "bid_px")
    q = q.select("ts", "sym", "bid_px", "ask_px", F.lit(1).alias("bid_sz"), F.lit(1).alias("ask_sz"), F.lit("X").alias("venue"))
    store = TableStore.create(spark, scratch(spark, "states"), quotes_spec(1 << 20), rotation_time="processing", max_batches=1 << 40)
    seen = [("none", status(store, 1.0, 0))]
    store.append(q, ["ts", "sym", "bid_px"], now_us=0)
    store.heartbeat(1_000_000)
    seen += [("frozen", status(store, 1.0, 1_500_000)), ("late", status(store, 1.0, 2_000_000))]
    store.heartbeat(3_000_000)
    seen += [("stuck", status(store, 1.0, 3_100_000, since=seen[1][1]))]
    return spark.createDataFrame([(name, x["state"], x["open_rows"], x["beats"]) for name, x in seen], "moment string, state string, open_rows bigint, beats bigint")


def s10_tumbling(spark, base):
    t = table(spark, base, "trades").where("ts IS NOT NULL")
    return windowed(t, "ts", ["venue"], "4 hours").select(F.unix_micros("window_start").alias("window_start"), "venue", F.col("rows").alias("n"))


def s11_sliding(spark, base):
    t = table(spark, base, "trades").where("ts IS NOT NULL")
    return windowed(t, "ts", [], "2 hours", "1 hour").select(F.unix_micros("window_start").alias("window_start"), F.col("rows").alias("n"))


def s11_sessions(spark, base):
    """Sessions of a symbol: trades that follow one another within ten minutes."""
    t = table(spark, base, "trades").where("ts IS NOT NULL AND sym IS NOT NULL")
    return sessions(t, "ts", ["sym"], "10 minutes").select("sym", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), F.col("rows").alias("n"))


def s1_stream_append(spark, base):
    """All live quotes through a stream into a store; rows by segment."""
    from ..streaming.sink import append_stream

    source = table(spark, base, "live_quotes")
    # A stream reads folders and patterns; the table may be a folder or one file.
    stream = spark.readStream.schema(source.schema).option("recursiveFileLookup", "true").parquet(f"{base}/live_quotes*.parquet")
    rows = stream.select("ts", "sym", F.col("px").alias("bid_px"), F.col("px").alias("ask_px"), F.lit(1).alias("bid_sz"), F.lit(1).alias("ask_sz"), F.lit("X").alias("venue"))
    root = scratch(spark, "stream")
    store = TableStore.create(spark, f"{root}/t", quotes_spec(65536), cycle="1d")
    query = append_stream(rows, store, ["ts", "sym", "bid_px"], f"{root}/checkpoint", f"live-{uuid.uuid4().hex}", once=True)
    query.awaitTermination()
    # Rows without timestamp go to the open interval, which depends on arrival: count them apart.
    return store.snapshot().scan().groupBy(F.floor(micros("ts") / 86_400_000_000).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def w_asof_quote_trade(spark, base):
    q = table(spark, base, "quotes").where("sym IS NOT NULL").select("sym", "ts", "quote_id", "bid_px", "ask_px")
    t = table(spark, base, "trades").where("sym IS NOT NULL").select("row_id", "sym", "ts", "px")
    return asof_join(t, q, ["sym"], "ts", ["quote_id", "bid_px", "ask_px"], "quote_id").select("row_id", "px", "quote_id", "bid_px", "ask_px")


def w_ohlc_4h(spark, base):
    t = table(spark, base, "trades").where("sym IS NOT NULL AND ts IS NOT NULL")
    return bars(t, ["sym"], CYCLE.floor_column(micros("ts")), ["ts", "row_id"], "px", "sz").drop("vwap")


def w_vwap(spark, base):
    t = table(spark, base, "trades").where("px IS NOT NULL AND sz IS NOT NULL")
    return t.groupBy("sym").agg(F.sum(F.col("px").cast("decimal(19,0)") * F.col("sz").cast("decimal(10,0)")).cast("decimal(38,0)").alias("traded"), F.sum("sz").alias("volume")).withColumn("vwap", F.col("traded").cast("double") / F.col("volume").cast("double"))


def w_ref_dim_join(spark, base):
    c = table(spark, base, "customer")
    n = table(spark, base, "nation").join(table(spark, base, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return resolve_codes(c, "c_nationkey", n, "n_nationkey").groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


def a10_sorted_roll(spark, base):
    """Place of each trade in the order of the sort key (sym, ts), ties by row_id."""
    t = table(spark, base, "trades").select("sym", "ts", "row_id")
    return positions(t, ["sym", "ts", "row_id"]).select("row_id", F.col("pos").alias("place"))


def lineitem_zone_map(spark, base):
    item = table(spark, base, "lineitem")
    at = micros("l_shipdate", item.schema["l_shipdate"].dataType)
    p = positions(item.select("l_orderkey", "l_linenumber", at.alias("ts"), "l_partkey"), ["l_orderkey", "l_linenumber", "ts", "l_partkey"])
    return zone_map(p.withColumn("batch", F.floor(F.col("pos") / 4096)), ["batch"], "ts", "l_partkey")


QUERIES = {f.__name__: f for f in (
    g8_symbol_agg, g8_live_symbols, f1_batch_rowcount, g1_g2_zone_map, f3_segment_seq, f4_interval_floor, f4_f3_rotation, f2_varlen_budget, f1_lazy_seal, f8_row_by_position,
    prune_time, prune_stat, prune_both, prune_none, prune_detached, sql_route_detached, scan_both, b3_versions, c13_empty_batches, c9_varlen_store, b16_feed, c18_backfill, r15_cycles, r17_pinned_reader, s6_idle_rotation, c4_all_types, c17_two_tables, a2_types, a7_layout, r14_cycles, store_range_scan, store_catalog,
    r18_encode_id, r18_decode_id, r7_segment_name, r8_parse_name, r9_listing_order, r10_next_seq, r11_latest_epoch, r12_interval_end, r16_retention, r19_civil_days,
    g4_in_progress_rows, g5_g6_coverage, b5_null_counts, b15_cells, b15_floats, x1_x2_length_bits, x3_layout_bytes, x4_sha256, x10_price, x11_decimal_halves, x12_unsigned, x13_hex, x14_overlap,
    s3_snapshot_freeze, s7_liveness, s7_states, s10_tumbling, s11_sliding, s11_sessions, s1_stream_append, w_asof_quote_trade, w_ohlc_4h, w_vwap, w_ref_dim_join, a10_sorted_roll, lineitem_zone_map,
)}
