"""Eight small tables whose batches and text are fixed: every type, nulls, byte budgets, bounds and empty batches."""

from decimal import Decimal

import pyarrow as pa
import pytest

from batchloom.sources.spec import TableSpec, column, schema
from batchloom.sources.store import TableStore
from tests.test_engine import ALL_TYPES, BASE, all_types_rows, rendered

NS = pa.timestamp("ns", "UTC")


def spec(columns, rows, like=None):
    if like is not None:
        return TableSpec.load(schema([column(c.name, c.type, **({"varlen_bytes": c.varlen_bytes} if c.varlen_bytes else {})) for c in like.columns], table="golden", schema_version=1, batch_rows=rows, time_column="ts", stats_column="i64"))
    return TableSpec.load(schema([column("ts", NS), *columns], table="golden", schema_version=1, batch_rows=rows, time_column="ts", stats_column="i64"))


def written(spark, tmp_path, kind, rows, max_batches=2):
    store = TableStore.create(spark, f"file://{tmp_path}/t", kind, rotation_time="processing", max_batches=max_batches)
    if rows:
        store.append(spark.createDataFrame(rows, kind.spark_schema), ["ts"], now_us=0)
    return store


def batches(store):
    return [(b.row_count, b.sealed) for b in store.snapshot().batches().orderBy("segment_id", "batch").collect()]


def varlen(budget, rows):
    return spec([column("i64", pa.int64()), column("sym", pa.string(), varlen_bytes=budget)], rows)


def test_all_types(spark, tmp_path):
    store = written(spark, tmp_path, spec(None, 4, ALL_TYPES), all_types_rows(6))
    assert batches(store) == [(4, True), (2, False)]
    first = store.snapshot().batches().where("batch = 0").first()
    assert (first.ts_min, first.ts_max, first.stat_min, first.stat_max) == (BASE, BASE + 3, 0, 3_000_000)


def test_all_null(spark, tmp_path):
    kind = spec(None, 8, ALL_TYPES)
    names = [c.name for c in kind.columns]
    rows = [tuple(BASE + r if n == "ts" else r if n == "i64" else None for n in names) for r in range(3)]
    store = written(spark, tmp_path, kind, rows, 1)
    assert batches(store) == [(3, False)]
    assert rendered(store)[1:] == [f"{BASE + r},,,,,{r},,,,,,,," for r in range(3)]


def test_empty_batch(spark, tmp_path):
    store = written(spark, tmp_path, spec(None, 8, ALL_TYPES), [])
    store.seal(now_us=0)
    assert batches(store) == [(0, True), (0, False)] and rendered(store)[1:] == []


def test_in_progress(spark, tmp_path):
    store = written(spark, tmp_path, spec(None, 8, ALL_TYPES), all_types_rows(5), 1)
    assert batches(store) == [(5, False)] and store.snapshot().prune((0, 1), (-5, -1)).count() == 1


def test_varlen_exact_capacity(spark, tmp_path):
    store = written(spark, tmp_path, varlen(16, 100), [(BASE, 10, "A" * 16), (BASE + 1, 20, "B")])
    assert batches(store) == [(1, True), (1, False)]
    assert rendered(store)[1:] == [f'{BASE},10,"{"A" * 16}"', f'{BASE + 1},20,"B"']


def test_varlen_empty(spark, tmp_path):
    store = written(spark, tmp_path, varlen(64, 8), [(BASE + r, r, "") for r in range(3)])
    store.seal()
    assert batches(store) == [(3, True), (0, False)]
    assert rendered(store)[1:] == [f'{BASE + r},{r},""' for r in range(3)]


def test_fixed_binary_widths(spark, tmp_path):
    widths = [1, 7, 16, 33]
    kind = spec([column("i64", pa.int64()), *[column(f"b{w}", pa.binary(w)) for w in widths]], 8)
    value = lambda w, r: bytearray((r * w + i) % 256 for i in range(w))
    store = written(spark, tmp_path, kind, [(BASE + r, r, *[value(w, r) for w in widths]) for r in range(4)])
    store.seal()
    assert batches(store) == [(4, True), (0, False)]
    assert rendered(store)[1:] == [",".join([str(BASE + r), str(r), *[value(w, r).hex() for w in widths]]) for r in range(4)]


def test_type_bounds(spark, tmp_path):
    kinds = {"i8": pa.int8(), "i16": pa.int16(), "i32": pa.int32(), "i64": pa.int64(), "u8": pa.uint8(), "u16": pa.uint16(), "u32": pa.uint32(), "u64": pa.uint64(), "f32": pa.float32(), "f64": pa.float64(), "dec": pa.decimal128(38, 9)}
    kind = spec([column(n, t) for n, t in kinds.items()], 8)
    single, double = 3.4028234663852886e38, 1.7976931348623157e308
    low = (-128, -(1 << 15), -(1 << 31), -(1 << 63), 0, 0, 0, Decimal(0), -single, -double, None)
    high = (127, (1 << 15) - 1, (1 << 31) - 1, (1 << 63) - 1, 255, 65535, (1 << 32) - 1, Decimal((1 << 64) - 1), single, double, None)
    zero = (0,) * 7 + (Decimal(0), 0.0, 0.0, Decimal(0))
    store = written(spark, tmp_path, kind, [(BASE, *low), (BASE + 1, *high), (BASE + 2, *zero)])
    store.seal()
    assert batches(store) == [(3, True), (0, False)]
    # The expected text; decimals beyond 38 digits are null here, as they have no Spark type.
    assert rendered(store)[1:] == [
        f"{BASE},-128,-32768,-2147483648,-9223372036854775808,0,0,0,0,-3.4028235E38,-1.7976931348623157E308,",
        f"{BASE + 1},127,32767,2147483647,9223372036854775807,255,65535,4294967295,18446744073709551615,3.4028235E38,1.7976931348623157E308,",
        f"{BASE + 2},0,0,0,0,0,0,0,0,0.0,0.0,0.000000000",
    ]
    bounds = store.snapshot().batches().where("batch = 0").first()
    assert (bounds.stat_min, bounds.stat_max) == (-(1 << 63), (1 << 63) - 1)
    beyond = spark.createDataFrame([(BASE, *[None] * 10, "170141183460469231731687303715.884105727")], "ts bigint, i8 int, i16 int, i32 int, i64 bigint, u8 int, u16 int, u32 bigint, u64 int, f32 float, f64 double, dec string")
    with pytest.raises(Exception):
        store.append(beyond, ["ts"], now_us=0)
    assert store.snapshot().count() == 3
