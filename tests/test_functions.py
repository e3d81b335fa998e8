import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from batchloom.errors import FormatError, SpecError, UnsupportedType
from batchloom.functions import values as V
from batchloom.functions.cycle import RollCycle
from batchloom.functions.names import SegmentName, id_column, id_parts, is_detached, name_column, name_parts
from batchloom.sources.spec import TableSpec, column, physical_kind, quotes_spec, schema, spark_type, trades_spec

HOUR = 3_600_000_000

# Accepted types with their kind and width.
ACCEPTED = [
    (pa.bool_(), "BOOL_BITMAP", 0), (pa.int8(), "FIXED", 1), (pa.int16(), "FIXED", 2), (pa.int32(), "FIXED", 4), (pa.int64(), "FIXED", 8),
    (pa.uint8(), "FIXED", 1), (pa.uint16(), "FIXED", 2), (pa.uint32(), "FIXED", 4), (pa.uint64(), "FIXED", 8), (pa.float32(), "FIXED", 4), (pa.float64(), "FIXED", 8),
    (pa.decimal128(38, 9), "FIXED", 16), (pa.date32(), "FIXED", 4), (pa.time64("ns"), "FIXED", 8), (pa.timestamp("ns", "UTC"), "FIXED", 8), (pa.timestamp("us", "UTC"), "FIXED", 8),
    (pa.timestamp("ns"), "FIXED", 8), (pa.timestamp("us"), "FIXED", 8), (pa.binary(1), "FIXED", 1), (pa.binary(7), "FIXED", 7), (pa.binary(16), "FIXED", 16), (pa.binary(33), "FIXED", 33),
    (pa.string(), "VARLEN", 0), (pa.binary(), "VARLEN", 0),
]
REJECTED = [
    pa.float16(), pa.decimal256(76, 9), pa.date64(), pa.time32("ms"), pa.time64("us"), pa.timestamp("s"), pa.timestamp("ms"), pa.large_string(), pa.large_binary(), pa.duration("ns"),
    pa.month_day_nano_interval(), pa.null(), pa.list_(pa.int32()), pa.struct([("a", pa.int32())]), pa.map_(pa.string(), pa.int32()), pa.dictionary(pa.int32(), pa.string()), pa.large_list(pa.int32()),
]


@pytest.mark.parametrize("kind, physical, width", ACCEPTED, ids=str)
def test_accepted_types(kind, physical, width):
    assert physical_kind(kind) == (physical, width)
    assert spark_type(kind) is not None
    own = {"varlen_bytes": 64} if physical == "VARLEN" else {}
    spec = TableSpec.load(schema([column("ts", pa.timestamp("us")), column("c", kind, **own)], table="t", schema_version=1, time_column="ts"))
    again = TableSpec.from_json(spec.to_json())
    assert again == spec and again.columns[1].type == kind and again.sha256 == spec.sha256


@pytest.mark.parametrize("kind", REJECTED, ids=str)
def test_rejected_types(kind):
    with pytest.raises(UnsupportedType):
        physical_kind(kind)
    with pytest.raises(SpecError):
        TableSpec.load(schema([column("ts", pa.timestamp("us")), column("c", kind)], table="t", schema_version=1, time_column="ts"))


def errors(columns=None, **meta):
    base = {"table": "t", "schema_version": 1, "time_column": "ts"} | meta
    with pytest.raises(SpecError) as e:
        TableSpec.load(schema(columns or [column("ts", pa.timestamp("us"))], **{k: v for k, v in base.items() if v is not None}))
    return e.value.errors


@pytest.mark.parametrize("columns, meta, text", [
    (None, {"table": None}, "required"), (None, {"table": " "}, "required"), (None, {"schema_version": None}, "required"), (None, {"schema_version": "x"}, "not an integer"),
    (None, {"batch_rows": 0}, "positive"), (None, {"batch_rows": "many"}, "not an integer"), (None, {"time_column": None}, "required"), (None, {"time_column": "no"}, "no column"),
    ([column("ts", pa.int64())], {}, "must be a Timestamp"), ([column("ts", pa.timestamp("us")), column("s", pa.float64())], {"stats_column": "s"}, "must be a fixed-width integer"),
    (None, {"stats_column": "no"}, "no column"), (None, {"colour": 1}, "unknown metadata key"), ([column("ts", pa.timestamp("us"), colour=1)], {}, "unknown metadata key"),
    ([column("ts", pa.timestamp("us")), column("s", pa.string())], {}, "required"), ([column("ts", pa.timestamp("us"), varlen_bytes=4)], {}, "only valid on Utf8/Binary"),
    ([column("ts", pa.timestamp("us")), column("s", pa.string(), varlen_bytes=0)], {}, "positive"), ([column("ts", pa.timestamp("us"), sort_key=-1)], {}, "negative"),
    ([column("ts", pa.timestamp("us"), sort_key=0), column("b", pa.int8(), sort_key=0)], {}, "duplicate"), ([column("ts", pa.timestamp("us"), ref="x")], {}, "signed Int32"),
    ([column("ts", pa.timestamp("us")), column("ts", pa.int8())], {}, "duplicate column name"),
])
def test_each_rule(columns, meta, text):
    assert any(text in e for e in errors(columns, **meta))


def test_all_errors_at_once_and_identity():
    assert len(errors([column("a", pa.int8()), column("a", pa.string())], table=None, schema_version="x")) >= 4
    a = pa.schema([column("ts", pa.timestamp("us"))], {"batchloom.table": "t", "batchloom.schema_version": "1", "batchloom.time_column": "ts", "other": "kept"})
    b = pa.schema([column("ts", pa.timestamp("us"))], dict(reversed(list(a.metadata.items()))))
    assert TableSpec.load(a).sha256 == TableSpec.load(b).sha256 != TableSpec.load(a.with_metadata({**a.metadata, b"other": b"changed"})).sha256
    assert TableSpec.load(a).batch_rows == 65_536 and TableSpec.load(a).columns[0].family == "base"
    assert quotes_spec().sort_columns == ["sym", "ts"] and TableSpec.load(a).sort_columns == ["ts"]
    assert trades_spec().families == ["base"] and quotes_spec().stats_column == "bid_px"


def test_layout_is_aligned_and_disjoint():
    spec = TableSpec.load(schema([column("ts", pa.timestamp("us")), column("f", pa.bool_()), column("s", pa.string(), varlen_bytes=33), column("b", pa.binary(33))], table="t", schema_version=1, batch_rows=65, time_column="ts"))
    at = 0
    for c in spec.batch_layout():
        for start in (c["validity"], c["offsets"], c["data"]):
            if start is not None:
                assert start % 64 == 0 and start >= at
                at = start + 1
    assert spec.batch_bytes % 4096 == 0 and spec.batch_bytes >= at


@pytest.mark.parametrize("text, minutes", [("30m", 30), ("4h", 240), ("6h", 360), ("1d", 1440), ("1m", 1)])
def test_cycles(text, minutes):
    assert RollCycle.parse(text).minutes == minutes


@pytest.mark.parametrize("text", ["7h", "90s", "25h", "0m", "0", "4x", "h", "", "-4h", "2d"])
def test_bad_cycles(text):
    with pytest.raises(ValueError):
        RollCycle.parse(text)


def test_floor():
    c = RollCycle.parse("4h")
    assert c.floor(6 * HOUR - 1) == 4 * HOUR and c.end(6 * HOUR) == 8 * HOUR and c.floor(-1) == -4 * HOUR


# Names and ids computed from the formula.
IDS = {
    "19700101.0.seg": 47185920, "20260101.0.seg": 63251468019302400, "20260101.3.seg": 63251468019302403,
    "20260101.1200.720m.0.seg": 63253014183936000, "20260810.0930.5m.12.seg": 63936107234099212, "99991231.2359.65535m.0.seg": 9069621622226255872,
}


@pytest.mark.parametrize("text, packed", IDS.items())
def test_ids(text, packed):
    name = SegmentName.parse(text)
    assert name.id == packed and str(SegmentName.from_id(packed)) == text
    assert is_detached(name, packed) and not is_detached(name, packed - 1) and not is_detached(name, None)


@pytest.mark.parametrize("text", ["", "x", "20260132.0.seg", "20261301.0.seg", "20260100.0.seg", "20260230.0.seg", "20260101.2400.60m.0.seg", "20260101.0060.60m.0.seg", "20260101.0.seg.tmp.1", "20260101.0000.0.seg"])
def test_bad_names(spark, text):
    with pytest.raises(FormatError):
        SegmentName.parse(text)
    row = spark.createDataFrame([(text,)], "name string").select(*name_parts(F.col("name"))).first()
    assert tuple(row) == (None, None, None)


@pytest.mark.parametrize("text", ["19691231.0.seg", "20260101.0000.0m.0.seg", "20260101.0000.65536m.0.seg", "20260101.32768.seg"])
def test_names_without_id(text):
    with pytest.raises(FormatError):
        SegmentName.parse(text).id
    assert not is_detached(SegmentName.parse(text), 1 << 62)


@pytest.mark.parametrize("packed", [-1, 0, (1 << 63) - 1])
def test_bad_ids(packed):
    with pytest.raises(FormatError):
        SegmentName.from_id(packed)


def test_listing_order():
    names = ["20260803.2000.240m.0", "20260804.0000.240m.0", "20260804.0", "20260804.0400.240m.0", "20260804.0400.240m.1"]
    assert [str(n) for n in sorted(SegmentName.parse(n + ".seg") for n in reversed(names))] == [n + ".seg" for n in names]


def test_columns_agree_with_python(spark):
    rows = [(SegmentName.parse(n).start_minute, SegmentName.parse(n).cycle, SegmentName.parse(n).seq, n, i) for n, i in IDS.items()]
    df = spark.createDataFrame(rows, "m bigint, c int, s bigint, name string, id bigint")
    start, cycle, seq = name_parts(F.col("name"))
    m, c, s = id_parts(F.col("id"))
    got = df.select("m", "c", "s", "name", "id", id_column(F.col("m"), F.col("c"), F.col("s")), name_column(F.col("m"), F.col("c"), F.col("s")), start, cycle, seq, m, c, s).collect()
    for r in got:
        r = tuple(r)
        assert r[5] == r[4] and r[6] == r[3] and r[7:10] == r[:3] and r[10:13] == r[:3]
    bad = spark.createDataFrame([(-1, 1440, 0), (0, 0, 0), (0, 1440, 32768)], "m bigint, c int, s bigint")
    assert [r[0] for r in bad.select(id_column(F.col("m"), F.col("c"), F.col("s"))).collect()] == [None] * 3
    junk = spark.createDataFrame([("nonsense",), ("20260230.0.seg",)], "name string")
    assert [tuple(r)[0] for r in junk.select(*name_parts(F.col("name"))).collect()] == [None, None]


def test_values(spark):
    top = (1 << 63) - 1
    df = spark.createDataFrame([(-1, 0), (top, 0), (0, -1), (5, 1), (None, 0)], "low bigint, high bigint")
    got = [r[0] for r in df.select(V.decimal_from_halves(F.col("low"), F.col("high"), 9)).collect()]
    want = [2**64 - 1, top, -(2**64), 2**64 + 5]
    assert [int(g.scaleb(9)) for g in got[:4]] == want and got[4] is None
    extreme = spark.createDataFrame([(0, -(1 << 63)), (-1, top)], "low bigint, high bigint")
    assert [r[0] for r in extreme.select(V.decimal_from_halves(F.col("low"), F.col("high"), 9)).collect()] == [None, None]
    word = spark.createDataFrame([(5, True), (5, False), (0, False)], "n bigint, sealed boolean").withColumn("w", V.length_word(F.col("n"), F.col("sealed")))
    assert [tuple(r) for r in word.select(V.row_count(F.col("w")), V.in_progress(F.col("w"))).collect()] == [(5, False), (5, True), (0, True)]
    assert spark.range(1).select(V.quoted(F.lit('a"b')), V.hex_lower(F.lit(b"\x00\xff"))).first()[:] == ('"a""b"', "00ff")


def test_spec_from_arrow_and_regions():
    import pyarrow as pa

    kind = schema([column("ts", pa.timestamp("us", "UTC")), column("s", pa.string(), varlen_bytes=64)], table="t", schema_version=1, batch_rows=8, time_column="ts")
    spec = TableSpec.from_arrow(kind.serialize().to_pybytes())
    assert spec == TableSpec.load(kind) and TableSpec.from_json(spec.to_json()) == spec
    for bad in (b"", b"nothing", kind.serialize().to_pybytes()[:40]):
        with pytest.raises(SpecError):
            TableSpec.from_arrow(bad)
    with pytest.raises(SpecError, match="dictionary|outside"):
        TableSpec.from_arrow(schema([column("ts", pa.timestamp("us")), pa.field("d", pa.dictionary(pa.int32(), pa.string()))], table="t", schema_version=1, time_column="ts").serialize().to_pybytes())
    regions = spec.segment_regions(3)
    edges = sorted(regions.values())
    assert [at % 4096 for at, _ in edges] == [0] * 4 and all(a + n <= b for (a, n), (b, _) in zip(edges, edges[1:]))
    assert regions["catalog"][1] == 192 and regions["data"][1] == 3 * spec.batch_bytes
