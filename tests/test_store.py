import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from batchloom.errors import FormatError, SegmentFull, StateError
from batchloom.operators.batching import model
from batchloom.functions.cycle import RollCycle
from batchloom.sources.spec import TableSpec, column, schema
from batchloom.sources.log import State, known_watermark, state_at
from batchloom.sources.store import TableStore

DAY = 86_400_000_000


def spec(rows=4, budget=1 << 20):
    return TableSpec.load(schema([column("ts", pa.timestamp("us", "UTC")), column("i64", pa.int64()), column("sym", pa.string(), varlen_bytes=budget)], table="t", schema_version=1, batch_rows=rows, time_column="ts", stats_column="i64"))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, v, s) for i, (t, v, s) in enumerate(rows)], "n bigint, us bigint, i64 bigint, sym string").withColumn("ts", F.timestamp_micros("us"))


def layout(store):
    return [(r.interval_start, r.seq, r.batch, r.row_count, r.sealed) for r in store.snapshot().batches().orderBy("segment_id", "batch").collect()]


def test_append_seals_lazily_and_rotates(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(2), max_batches=2)
    store.append(frame(spark, [(k, k, "a") for k in range(4)]), ["n"])
    assert layout(store) == [(0, 0, 0, 2, True), (0, 0, 1, 2, False)]
    frozen = store.snapshot()
    store.append(frame(spark, [(10, 10, "b"), (DAY, 11, "c")]), ["n"])
    assert layout(store) == [(0, 0, 0, 2, True), (0, 0, 1, 2, True), (0, 1, 0, 1, True), (DAY, 0, 0, 1, False)]
    assert frozen.count() == 4 and frozen.scan().count() == 4 and store.snapshot().count() == 6
    assert [r.name for r in store.snapshot().segments().orderBy("segment_id").collect()] == ["19700101.0.seg", "19700101.1.seg", "19700102.0.seg"]
    assert store.close() and store.close() is None
    assert all(r[4] for r in layout(store))


def test_open_batch_goes_on(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(4), max_batches=8)
    for k in range(3):
        store.append(frame(spark, [(3 * k + j, 3 * k + j, "x") for j in range(3)]), ["n"])
    assert layout(store) == [(0, 0, 0, 4, True), (0, 0, 1, 4, True), (0, 0, 2, 1, False)]
    got = store.snapshot().scan().orderBy("segment", "batch", "ts").select("i64").collect()
    assert [r[0] for r in got] == list(range(9))


@pytest.mark.parametrize("split", [1, 2, 5])
def test_byte_budget_matches_model(spark, tmp_path, split):
    sizes = [3, 9, 1, 16, 0, 5, 5, 6, 2, 2, 2, 2, 2, 16, 16, 1]
    rows = [(k * 1000 + (DAY if k > 10 else 0), k, "x" * n) for k, n in enumerate(sizes)]
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(4, 16), max_batches=2)
    step = -(-len(rows) // split)
    for a in range(0, len(rows), step):
        store.append(frame(spark, rows[a : a + step]), ["n"])
    got = store.snapshot().scan().select("i64", "segment", "batch").orderBy("i64").collect()
    want = model([(t, [len(s)]) for t, _, s in rows], RollCycle(1440), 4, 2, [16])
    assert [(r.segment >> 31, r.segment & 32767, r.batch) for r in got] == [(i // 60_000_000, s, b) for i, s, b, _ in want]


def test_values_out_of_bounds_raise(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(4, 4))
    with pytest.raises(Exception, match="byte budget"):
        store.append(frame(spark, [(0, 0, "too long")]), ["n"])
    with pytest.raises(StateError, match="missing"):
        store.append(frame(spark, [(0, 0, "a")]).drop("i64"), ["n"])
    assert store.snapshot().count() == 0 and layout(store) == []


def test_prune_keeps_open_batches_and_filters_rows(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(2))
    store.append(frame(spark, [(100, 10, "a"), (101, 11, "a"), (200, 20, "b"), (201, 21, "b"), (300, 30, "c")]), ["n"])
    snap = store.snapshot()
    kept = lambda *r: [x.batch for x in snap.prune(*r).orderBy("batch").collect()]
    assert kept((150, 250), None) == [1, 2]
    assert kept(None, (10, 15)) == [0, 2]
    assert kept((1000, 2000), (1000, 2000)) == [2]
    assert kept() == [0, 1, 2]
    assert [r.i64 for r in snap.scan((150, 250)).orderBy("i64").collect()] == [20, 21]
    assert [r.i64 for r in snap.scan(None, (11, 20)).orderBy("i64").collect()] == [11, 20]
    assert snap.scan((150, 250)).schema == snap.scan((5000, 6000)).schema


def test_nulls_in_bounds(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(2))
    store.append(frame(spark, [(1000, 7, None), (1001, None, "")]), ["n"])
    store.append(frame(spark, [(None, None, "x")]), ["n"], now_us=5)
    b = store.snapshot().batches().orderBy("batch").collect()
    assert (b[0].ts_min, b[0].ts_max, b[0].stat_min, b[0].stat_max) == (1000, 1001, 7, 7)
    assert b[1].ts_min is None and b[1].stat_min is None
    assert store.snapshot().null_counts().orderBy("batch").first().i64_nulls == 1


def test_detach_and_retention(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(2))
    store.append(frame(spark, [(k * DAY, k, "a") for k in range(4)]), ["n"])
    ids = [r.segment_id for r in store.snapshot().segments().orderBy("segment_id").collect()]
    store.detach(ids[1])
    assert store.snapshot().count() == 2 and store.snapshot().scan().count() == 2
    store.reattach()
    old = store.snapshot()
    assert store.retain(2) == ids[:2]
    assert store.snapshot().count() == 2 and old.count() == 4 and old.scan().count() == 4
    assert store.vacuum(0) == 2 and store.snapshot().scan().count() == 2


def test_epoch_seal_rotate_heartbeat(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store = TableStore.create(spark, path, spec(4), rotation_time="processing", cycle="4h")
    assert store.open_writer() == 1 and store.seal() is None
    store.append(frame(spark, [(1, 1, "a")]), ["n"], now_us=0)
    store.seal()
    store.append(frame(spark, [(2, 2, "a")]), ["n"], now_us=1)
    assert layout(store) == [(0, 0, 0, 1, True), (0, 0, 1, 1, False)]
    assert store.heartbeat(5) == 1 and not layout(store)[1][4]
    assert store.heartbeat(4 * 3600 * 1_000_000) == 2 and layout(store)[1][4]
    again = TableStore.create(spark, path, spec(4), rotation_time="processing", cycle="4h")
    assert again.open_writer() == 2
    again.append(frame(spark, [(3, 3, "a")]), ["n"], now_us=2)
    assert layout(again)[-1] == (0, 1, 0, 1, False) and again.snapshot().latest_epoch() == 2


def test_repeated_source_and_lost_race(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(4))
    df = frame(spark, [(1, 1, "a")])
    assert store.append(df, ["n"], source=("q", 7)) and store.append(df, ["n"], source=("q", 7)) is None
    with pytest.raises(StateError, match="first"):
        store.files.publish("_log/000000000001.json", "{}")
    assert store.snapshot().count() == 1


def test_limits_and_identity(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(1), max_batches=1, max_segments=2)
    with pytest.raises(SegmentFull):
        store.append(frame(spark, [(k, k, "a") for k in range(3)]), ["n"])
    assert store.snapshot().count() == 0
    with pytest.raises(FormatError, match="another schema"):
        TableStore.create(spark, f"file://{tmp_path}/t", spec(9))
    two = schema([column("ts", pa.timestamp("us")), column("a", pa.int32(), family="aux")], table="t", schema_version=1, time_column="ts")
    with pytest.raises(StateError, match="family"):
        TableStore.create(spark, f"file://{tmp_path}/u", TableSpec.load(two))
    with pytest.raises(FormatError, match="no table"):
        TableStore(spark, f"file://{tmp_path}/none").snapshot().scan()


@pytest.mark.parametrize("value", ["5", 5.0, True, -1, 1 << 63, [5], {}])
def test_malformed_watermarks(value):
    with pytest.raises(FormatError):
        known_watermark(value)
    with pytest.raises(FormatError):
        State().take(1, {"schema_sha256": "x", "watermark": value}, "x")


def test_watermark_is_part_of_a_version(spark, tmp_path):
    assert known_watermark(None) is None and known_watermark(0) == 0 and known_watermark((1 << 63) - 1) == (1 << 63) - 1
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(2))
    store.append(frame(spark, [(k * DAY, k, "a") for k in range(3)]), ["n"])
    before, first = store.snapshot(), store.snapshot().segments().agg(F.min("segment_id")).first()[0]
    with pytest.raises(ValueError):
        store.detach(None)
    with pytest.raises(FormatError):
        store.detach(-1)
    assert store.reattach() is None and store.detach(first) == 2
    assert before.count() == 3 and store.snapshot().count() == 2 and store.snapshot(1).count() == 3
    assert store.snapshot().scan((0, 10 * DAY)).count() == 2
    assert store.reattach() == 3 and store.reattach() is None and store.snapshot().count() == 3


def test_a_writer_that_loses_the_race_harms_nothing(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(4))
    store.append(frame(spark, [(k, k, "a") for k in range(5)]), ["n"])
    other = TableStore(spark, store.path)
    commit = store._commit

    def late(seen=None, **content):
        other.append(frame(spark, [(k, 100 + k, "b") for k in range(3)]), ["n"])
        return commit(seen, **content)

    store._commit = late
    with pytest.raises(StateError, match="first"):
        store.append(frame(spark, [(9, 9, "lost")]), ["n"])
    assert sorted(r.i64 for r in store.snapshot().scan().collect()) == [0, 1, 2, 3, 4, 100, 101, 102]
    assert store.snapshot().count() == 8 and len(store.files.names("data")) == len(store.files.names("_batches")) == 2
    store._commit = commit
    # A commit that touches neither rows nor the tail does not stand in a writer's way.
    store._commit = lambda seen=None, **content: (other.detach(0), commit(seen, **content))[1]
    assert store.append(frame(spark, [(9, 9, "kept")]), ["n"]) == 4 and store.snapshot().count() == 9


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(1), max_batches=1, max_segments=2)
    with pytest.raises(SegmentFull):
        store.append(frame(spark, [(k, k, "a") for k in range(3)]), ["n"])
    assert store.files.names("data") == store.files.names("_batches") == []
    assert store.append(frame(spark, [(k, k, "a") for k in range(2)]), ["n"]) == 1


def test_digest_of_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("batchloom.sources.store.DIGEST_EVERY", 2)
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(2))
    for k in range(5):
        store.append(frame(spark, [(k, k, "a")]), ["n"], source=("q", k))
    assert [n for n in store.files.names("_log") if n.endswith("digest")] == ["000000000002.digest", "000000000004.digest"]
    state = store.state()
    assert state.version == 5 and len(state.attempts) == 1 and state.catalog and state.sources == {"q": 4}
    assert store.state(3).version == 3 and len(store.state(3).attempts) == 1 and store.state(1).catalog is None
    assert [store.snapshot(v).count() for v in range(6)] == [0, 1, 2, 3, 4, 5]
    assert sorted(r.i64 for r in store.snapshot().scan().collect()) == [0, 1, 2, 3, 4]


def test_empty_batches(spark, tmp_path):
    """Sealing opens the next batch at once; sealing nothing leaves an empty sealed batch."""
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(8), max_batches=3)
    assert layout(store) == [] and store.seal() is None and store.snapshot().scan().count() == 0
    store.seal(now_us=5)
    assert layout(store) == [(0, 0, 0, 0, True), (0, 0, 1, 0, False)]
    assert [(x.batch, x.ts_min) for x in store.snapshot().prune((1, 2)).collect()] == [(1, None)]
    store.append(frame(spark, [(1, 1, "a")]), ["n"])
    assert layout(store) == [(0, 0, 0, 0, True), (0, 0, 1, 1, False)]
    store.seal()
    assert layout(store)[1:] == [(0, 0, 1, 1, True), (0, 0, 2, 0, False)]
    assert store.close() and store.close() is None
    assert layout(store)[1:] == [(0, 0, 1, 1, True), (0, 0, 2, 0, False)]  # an open batch without rows stays in progress
    assert store.snapshot().scan().count() == 1 and store.snapshot().segments().first().batches == 3
    store.append(frame(spark, [(2, 2, "b")]), ["n"])
    assert layout(store)[-1] == (0, 1, 0, 1, False)
    again = TableStore(spark, store.path, max_batches=3)
    again.open_writer(now_us=7)
    assert layout(again)[-2:] == [(0, 1, 0, 1, False), (0, 2, 0, 0, False)] and again.snapshot().latest_epoch() == 2


def test_latest_epoch_is_that_of_the_last_name(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(2))
    store.append(frame(spark, [(5 * DAY, 1, "a")]), ["n"])
    store.open_writer()
    store.append(frame(spark, [(DAY, 2, "b")]), ["n"])
    assert store.epoch == 2 and store.snapshot().latest_epoch() == 1


def rows_read(df):
    """Rows that the file scans of an executed plan gave out."""
    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().apply("numOutputRows").value() if name == "FileSourceScanExec" else 0
        children = p.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_single_batches_are_skipped(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(100))
    rows = spark.range(20_000).select(F.col("id").alias("n"), F.timestamp_micros("id").alias("ts"), F.col("id").alias("i64"), F.lit("a").alias("sym"))
    store.append(rows, ["n"])
    store.close()
    snap = store.snapshot()
    assert snap.prune((5050, 5149)).count() == 2 and snap.files((5050, 5149)).count() == 1
    near = snap.scan((5050, 5149))
    assert near.count() == 100 and rows_read(near) <= 400
    assert rows_read(snap.scan(None, (0, 2999))) <= 3200 and rows_read(snap.scan()) == 20_000


def test_heartbeats_while_rows_are_appended(spark, tmp_path):
    import threading

    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(64), rotation_time="processing", cycle="30m")
    store.open_writer()
    beats, stop, failed = [0], threading.Event(), []

    def beat():
        while not stop.is_set():
            try:
                store.heartbeat(beats[0] * 60_000_000 * 31)
                beats[0] += 1
            except Exception as e:
                failed.append(e)

    thread = threading.Thread(target=beat)
    thread.start()
    try:
        for k in range(2):
            store.append(frame(spark, [(k, k, "a")]), ["n"], now_us=k)
    finally:
        stop.set()
        thread.join()
    import json

    assert not failed and json.loads(store.files.read("_heartbeat.json"))["beats"] == beats[0] > 0
    assert store.snapshot().count() == store.snapshot().scan().count() == 2


def test_readers_during_writes(spark, tmp_path):
    """Counts never fall, and what a version showed it shows again."""
    import threading

    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(3), max_batches=2)
    failed, seen, stop = [], {}, threading.Event()

    def read():
        last = 0
        reader = TableStore(spark, store.path)
        while not stop.is_set():
            try:
                snap = reader.snapshot()
                values = sorted(r.i64 for r in snap.scan().select("i64").collect())
                assert values == list(range(len(values))) and len(values) >= last and seen.setdefault(snap.version, values) == values
                last = len(values)
            except Exception as e:
                failed.append(e)
                return

    threads = [threading.Thread(target=read) for _ in range(2)]
    for t in threads:
        t.start()
    try:
        for k in range(3):
            store.append(frame(spark, [(5 * k + j, 5 * k + j, "a") for j in range(5)]), ["n"])
    finally:
        stop.set()
        for t in threads:
            t.join()
    assert not failed and len(seen) > 1 and store.snapshot().count() == 15


def damaged(spark, tmp_path):
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(4))
    store.append(frame(spark, [(k, k, "a") for k in range(6)]), ["n"])
    store.append(frame(spark, [(k, k, "a") for k in range(6, 9)]), ["n"])
    return store, tmp_path / "t"


def rewrite(path, text):
    path.write_text(text)
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("name, text", [
    ("_log/000000000001.json", "{"), ("_log/000000000001.json", "[]"), ("_log/000000000001.json", ""), ("_log/000000000002.json", '{"schema_sha256": "other"}'), ("_log/000000000001.json", None),
    ("_log/000000000002.json", '{"schema_sha256": "%s", "tail": {"interval": 0, "nowhere": 1}}'), ("_log/000000000002.json", '{"schema_sha256": "%s", "watermark": "7"}'), ("_log/000000000002.json", '{"schema_sha256": "%s", "tombstones": ["x"], "at": 1}'), ("_log/000000000002.json", '{"schema_sha256": "%s", "source": 5}'),
    ("spec.json", "{"), ("spec.json", "{}"), ("spec.json", '{"columns": []}'), ("spec.json", None),
])
def test_damaged_text_is_an_error(spark, tmp_path, name, text):
    store, folder = damaged(spark, tmp_path)
    if text is None:
        (folder / name).unlink()
    else:
        rewrite(folder / name, text.replace("%s", store.spec.sha256))
    with pytest.raises(FormatError):
        TableStore(spark, store.path).snapshot().scan()


@pytest.mark.parametrize("what", ["hash", "rows", "gone", "file", "short"])
def test_damaged_files_are_an_error(spark, tmp_path, what):
    import shutil

    store, folder = damaged(spark, tmp_path)
    batches = sorted((folder / "_batches").iterdir())[0]
    part = next(folder.glob("data/commit=*/segment=*/*.parquet"))
    if what in ("hash", "rows"):
        wrong = spark.read.parquet(f"file://{batches}").withColumn(*(("schema_sha256", F.lit("x")) if what == "hash" else ("row_count", F.lit(5).cast("bigint")))).collect()
        shutil.rmtree(batches)
        spark.createDataFrame(wrong).write.parquet(f"file://{batches}")
    elif what == "gone":
        shutil.rmtree(batches)
    elif what == "file":
        part.unlink()
    else:
        part.write_bytes(part.read_bytes()[:-20])
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        TableStore(spark, store.path).snapshot().scan().collect()


def test_log_without_any_commit():
    assert state_at([], lambda name: None, "x") == State()


def test_listing(spark, tmp_path):
    assert TableStore(spark, f"file://{tmp_path}/none").listing() == []
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(2), max_batches=1)
    assert store.listing() == []
    store.append(frame(spark, [(DAY, 1, "a"), (DAY, 2, "a"), (DAY, 3, "a"), (0, 4, "b")]), ["n"])
    assert store.listing() == ["19700101.0.seg", "19700102.0.seg", "19700102.1.seg"]


def test_vacuum_removes_what_a_killed_writer_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("batchloom.sources.store.DIGEST_EVERY", 2)
    store = TableStore.create(spark, f"file://{tmp_path}/t", spec(4))
    for k in range(3):
        store.append(frame(spark, [(k, k, "a")]), ["n"])
    for name in ("data/commit=000000000004-killed/segment=1", "_batches/000000000004-killed"):
        (tmp_path / "t" / name).mkdir(parents=True)
    assert store.vacuum(3600) == 0 and store.vacuum(0) == 2
    assert len(store.files.names("data")) == len(store.files.names("_batches")) == 3
    assert store.snapshot().scan().count() == 3
