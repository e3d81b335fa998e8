"""Append-only tables of segments and batches on Parquet, with a manifest, frozen snapshots and pruned scans.

Layout of a table's folder::

    spec.json                         the specification
    _log/<version>.json, .digest      commits and, now and then, the state they amount to (see ``log``)
    _batches/<attempt>/               a Parquet row per batch and file that one commit wrote (a partial zone map)
    _catalog/<attempt>/               all such rows up to a digest
    data/commit=<attempt>/segment=<id>/part-*.parquet
    _heartbeat.json                   the live writer's counter

A commit is published by creating its log file, which fails if another writer was first; nothing else is ever changed,
and what an attempt writes lies below a name of its own, so that one which loses the race harms nobody's rows. Readers pin
a version and see neither later commits nor files of unfinished ones. A batch that several commits filled, or that lies
in several files, has several manifest rows: they are partial aggregates, which the catalog sums up.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import FormatError, SegmentFull, StateError
from ..functions.cycle import MINUTE_US, RollCycle
from ..functions.names import SegmentName, id_column, id_parts, name_column
from ..functions.timeexpr import micros
from ..operators.batching import by_byte_budget, positions, small
from ..operators.zonemap import null_counts, survives
from .files import Files
from .log import DIGEST_EVERY, State, Tail, known_watermark, numbered, state_at
from .spec import TableSpec

log = logging.getLogger(__name__)

ATTEMPTS = 20  # to publish a commit that depends on no other
RANGES = 256  # segments up to which a scan's batch ranges are pushed down beside the row filter
_BATCH_ROW = "segment_id bigint, interval_start bigint, cycle int, seq int, batch bigint, file string, row_count bigint, ts_min bigint, ts_max bigint, stat_min decimal(20,0), stat_max decimal(20,0), epoch bigint, schema_sha256 string"


class TableStore:
    """Writer and reader of one table; one writer at a time, others are refused."""

    def __init__(self, spark: SparkSession, path: str, cycle: str = "1d", max_batches: int = 1024, max_segments: int | None = None, rotation_time: str = "event"):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.cycle, self.max_batches, self.max_segments = RollCycle.parse(cycle), max_batches, max_segments
        if rotation_time not in ("event", "processing"):
            raise ValueError("rotation_time is 'event' or 'processing'")
        self.rotation_time = rotation_time
        self.epoch: int | None = None
        self._spec: TableSpec | None = None
        # A heartbeat may come from another thread than rows do.
        self._writing, self._beating = threading.RLock(), threading.Lock()

    # -- definition -------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: TableSpec, **options) -> TableStore:
        """Create a table, or reopen one whose specification is identical."""
        spec.require_one_family()
        store = cls(spark, path, **options)
        if store.files.read("spec.json") is None:
            store.files.publish("spec.json", spec.to_json())
        elif store.spec.sha256 != spec.sha256:
            raise FormatError("the table exists with another schema")
        return store

    @property
    def spec(self) -> TableSpec:
        """The specification, which never changes once written."""
        if self._spec is None:
            self._spec = self._read_spec()
        return self._spec

    def _read_spec(self) -> TableSpec:
        text = self.files.read("spec.json")
        if text is None:
            raise FormatError(f"no table at {self.path}")
        try:
            return TableSpec.from_json(text)
        except (ValueError, TypeError, KeyError) as e:
            raise FormatError(f"malformed specification: {e}") from None

    # -- log --------------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return numbered(self.files.names("_log"), ".json")

    def state(self, version: int | None = None) -> State:
        return state_at(self.files.names("_log"), self.files.read, self.spec.sha256, version)

    def _commit(self, seen: State | None = None, **content: object) -> int:
        """Publish a commit on top of whatever is there, unless rows or the tail have changed since ``seen``."""
        for _ in range(ATTEMPTS):
            now = self.state()
            if seen is not None and now.moved != seen.moved:
                raise StateError(f"version {now.moved} exists already: another writer was first")
            version = now.version + 1
            try:
                self.files.publish(f"_log/{version:012d}.json", json.dumps(content | {"epoch": self.epoch, "at": time.time(), "schema_sha256": self.spec.sha256}))
            except StateError:
                continue
            if version % DIGEST_EVERY == 0:
                self._digest(version)
            return version
        raise StateError("other writers were first again and again")

    def _digest(self, version: int) -> None:
        state = self.state(version)
        folder = f"_catalog/{version:012d}-{uuid.uuid4().hex}"
        rows = self.partials(state)
        rows.coalesce(max(1, len(state.attempts) // DIGEST_EVERY)).write.parquet(f"{self.path}/{folder}")
        state.catalog, state.attempts = folder, []
        self.files.publish(f"_log/{version:012d}.digest", json.dumps(asdict(state)), replace=True)

    def tail(self) -> Tail:
        return self.state().position

    # -- writing ----------------------------------------------------------------------------------------------------

    def open_writer(self, now_us: int | None = None) -> int:
        """Start a writer: its epoch is one above any before it. With ``now_us`` it opens the next free segment of that
        instant's interval at once; an open batch of the writer before stays in progress, as its end is unknown."""
        state = self.state()
        self.epoch = 1 + state.epoch
        if now_us is not None:
            tail = state.position
            interval = max(self.cycle.floor(now_us), tail.interval if tail.interval is not None else self.cycle.floor(now_us))
            left = [[_packed(tail, self.cycle), tail.batch, state.tail_epoch, True]] if tail.open else []
            taken = self.partials(state).where((F.col("interval_start") == interval) & (F.col("cycle") == self.cycle.minutes)).agg(F.max("seq")).first()[0]
            held = [SegmentName.from_id(m[0]).seq for m in [*state.marks, *left] if SegmentName.from_id(m[0]).start_minute == interval // MINUTE_US]
            seq = 1 + max([-1 if taken is None else taken, *held])
            self._commit(state, kind="open", marks=left, tail=asdict(Tail(interval, seq, 0, 0, [0] * len(self.spec.budgets), False)))
        return self.epoch

    def _checked(self, df: DataFrame) -> list[Column]:
        """Columns of the specification by name, cast under ANSI rules; a wrong binary width or an oversized value raises."""
        spec = self.spec
        missing = [c.name for c in spec.columns if c.name not in df.columns]
        if missing:
            raise StateError(f"columns are missing: {missing}")
        out = []
        for c, f in zip(spec.columns, spec.spark_schema):
            value = F.col(f"`{c.name}`").cast(f.dataType)
            if str(c.type).startswith("fixed_size_binary"):
                value = F.when(F.octet_length(value) != c.width, F.raise_error(F.lit(f"{c.name}: not {c.width} bytes")).cast("binary")).otherwise(value)
            if c.varlen_bytes is not None:
                value = F.when(F.octet_length(value) > c.varlen_bytes, F.raise_error(F.lit(f"{c.name}: longer than its byte budget")).cast(f.dataType)).otherwise(value)
            out.append(value.alias(c.name))
        return out

    def _time(self) -> Column:
        c = next(c for c in self.spec.columns if c.name == self.spec.time_column)
        kind = self.spec.spark_schema[c.name].dataType
        return F.col(f"`{c.name}`") if isinstance(kind, T.LongType) else micros(F.col(f"`{c.name}`"), kind)

    def _time_us(self) -> Column:
        nanos = isinstance(self.spec.spark_schema[self.spec.time_column].dataType, T.LongType)
        return F.floor(self._time() / 1000) if nanos else self._time()

    def append(self, df: DataFrame, order: list[str], now_us: int | None = None, source: tuple[str, int] | None = None, budgets: bool = True) -> int | None:
        """Commit ``df`` in the order of ``order`` (columns of df) and return the version; None for a repeated source.

        ``source``: (query, micro-batch) of a stream; one that has been committed before is skipped. An empty ``df``
        commits nothing. With rotation by event time, rows go to the interval of their timestamp (null: that of the
        open batch, else of now); by processing time, all to the interval of ``now_us``. An attempt that fails, or finds
        another writer's rows committed meanwhile, leaves nothing behind.
        """
        with self._writing:
            if self.epoch is None:
                self.open_writer()
            seen = self.state()
            if source and source[1] <= seen.sources.get(source[0], -1):
                return None
            attempt = f"{seen.version + 1:012d}-{uuid.uuid4().hex}"
            try:
                return self._append(df, order, seen, attempt, int(time.time() * 1e6) if now_us is None else now_us, source, budgets)
            except BaseException:
                self.files.delete(f"data/commit={attempt}")
                self.files.delete(f"_batches/{attempt}")
                raise

    def _append(self, df: DataFrame, order: list[str], seen: State, attempt: str, now: int, source: tuple[str, int] | None, budgets: bool) -> int | None:
        tail, spec = seen.position, self.spec
        present = tail.interval if tail.interval is not None else self.cycle.floor(now)
        if self.rotation_time == "processing":
            interval = F.lit(max(self.cycle.floor(now), present))  # a clock that steps back opens no earlier interval
        else:
            interval = F.coalesce(self.cycle.floor_column(self._time_us()), F.lit(present))
        # The order columns need not belong to the table: they travel beside the checked ones.
        kept = [F.col(f"`{c}`").alias(f"_order{i}") for i, c in enumerate(order)]
        checked = df.select(*self._checked(df), *kept).withColumn("_interval", interval)
        names = [c.name for c in spec.columns]
        by = [f"_order{i}" for i in range(len(order))]
        if budgets and spec.budgets:
            carry = (tail.interval, tail.rows, tail.used) if tail.open and tail.rows else None
            placed = by_byte_budget(checked, by, ["_interval"], spec.budgets, spec.batch_rows, carry)
        else:
            placed = positions(checked, by, ["_interval"])
            ahead = F.when(F.col("_interval") == F.lit(tail.interval), F.lit(tail.rows)).otherwise(0) if tail.open else F.lit(0)
            placed = placed.withColumn("batch", F.floor((F.col("pos") + ahead) / F.lit(spec.batch_rows)))
        # Later intervals begin at their next free segment; the open one goes on where it stopped.
        if seen.attempts or seen.catalog or seen.marks:
            taken = self._partials_with_marks(seen).where(F.col("cycle") == self.cycle.minutes).groupBy(F.col("interval_start").alias("_interval")).agg(F.max("seq").alias("_seq"))
            placed = placed.join(small(taken), "_interval", "left")
        else:
            placed = placed.withColumn("_seq", F.lit(None).cast("int"))
        goes_on = (F.col("_interval") == F.lit(tail.interval)) if tail.open else F.lit(False)
        batch = F.col("batch") + F.when(goes_on, F.lit(tail.batch)).otherwise(0)
        first_seq = F.when(goes_on, F.lit(tail.seq)).otherwise(F.coalesce(F.col("_seq") + 1, F.lit(0)))
        placed = placed.withColumn("_all", batch).withColumn("seq", (first_seq + F.floor(F.col("_all") / self.max_batches)).cast("int")).withColumn("batch", F.pmod(F.col("_all"), F.lit(self.max_batches)).cast("bigint"))
        start = F.floor(F.col("_interval") / MINUTE_US)
        placed = placed.withColumn("segment", id_column(start, F.lit(self.cycle.minutes), F.col("seq")))
        out = placed.select(*[F.col(f"`{n}`") for n in names], "batch", F.col("pos").alias("row_pos"), "segment")
        # Rows come range-partitioned in their order: each task writes its stretch of a segment, without another shuffle.
        # Pages no longer than a batch let a reader skip single batches by the column index.
        writer = out.sortWithinPartitions("segment", "batch", "row_pos").write.option("parquet.page.row.count.limit", str(min(20_000, spec.batch_rows)))
        writer.partitionBy("segment").parquet(f"{self.path}/data/commit={attempt}")

        if not any(n.startswith("segment=") for n in self.files.names(f"data/commit={attempt}")):
            self.files.delete(f"data/commit={attempt}")
            return None
        written = self.spark.read.schema(self._data_schema()).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/commit={attempt}")
        stat = F.col(f"`{spec.stats_column}`").cast("decimal(20,0)") if spec.stats_column else F.lit(None).cast("decimal(20,0)")
        start_minute, cycle, seq = id_parts(F.col("segment"))
        file = F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1)
        zones = written.select("segment", "batch", file.alias("file"), self._time().alias("t"), stat.alias("s"), *[F.octet_length(f"`{c}`").alias(f"b{i}") for i, c in enumerate(spec.budgets)])
        zones = zones.groupBy("segment", "batch", "file").agg(F.count(F.lit(1)).alias("row_count"), F.min("t").alias("ts_min"), F.max("t").alias("ts_max"), F.min("s").alias("stat_min"), F.max("s").alias("stat_max"), *[F.coalesce(F.sum(f"b{i}"), F.lit(0)).alias(f"b{i}") for i in range(len(spec.budgets))])
        zones = zones.select(F.col("segment").alias("segment_id"), (start_minute * MINUTE_US).alias("interval_start"), cycle.cast("int").alias("cycle"), seq.cast("int").alias("seq"), "batch", "file", "row_count", "ts_min", "ts_max", "stat_min", "stat_max", F.lit(self.epoch).cast("bigint").alias("epoch"), F.lit(spec.sha256).alias("schema_sha256"), *[f"b{i}" for i in range(len(spec.budgets))])
        folder = f"{self.path}/_batches/{attempt}"
        zones.write.parquet(folder)

        by_batch = self.spark.read.parquet(folder).groupBy("interval_start", "seq", "batch").agg(F.sum("row_count").alias("row_count"), *[F.sum(f"b{i}").alias(f"b{i}") for i in range(len(spec.budgets))])
        newest = by_batch.orderBy(F.desc("interval_start"), F.desc("seq"), F.desc("batch")).first()
        if self.max_segments is not None and newest["seq"] >= self.max_segments:
            raise SegmentFull(f"segment {newest['seq']} would exceed {self.max_segments}")
        ahead = tail.open and (tail.interval, tail.seq, tail.batch) == (newest["interval_start"], newest["seq"], newest["batch"])
        # A batch that was opened and gets no row stays in the catalog.
        marks = [[_packed(tail, self.cycle), tail.batch, seen.tail_epoch, False]] if tail.open and not tail.rows and not ahead else []
        if tail.open and tail.interval > newest["interval_start"]:
            following, marks = tail, []  # late rows only: the open batch stays open, theirs are sealed
        else:
            used = [newest[f"b{i}"] + (tail.used[i] if ahead and tail.used else 0) for i in range(len(spec.budgets))]
            following = Tail(newest["interval_start"], newest["seq"], newest["batch"], newest["row_count"] + (tail.rows if ahead else 0), used, False)
        return self._commit(seen, kind="append", attempt=attempt, marks=marks, source=list(source) if source else None, tail=asdict(following))

    def seal(self, rotate: bool = False, now_us: int | None = None) -> int | None:
        """Seal the open batch, rows or not, and open the next one at once; with ``rotate`` the next row opens a new
        segment, and an open batch without rows stays in progress. A table without any batch opens one at ``now_us``."""
        with self._writing:
            seen = self.state()
            tail, marks = seen.position, []
            if not tail.open:
                if rotate or now_us is None:
                    return None
                self.open_writer(now_us)
                seen = self.state()
                tail = seen.position
            if not tail.rows:
                marks = [[_packed(tail, self.cycle), tail.batch, seen.tail_epoch, rotate]]
            if rotate or tail.batch + 1 >= self.max_batches:
                following = Tail(tail.interval, tail.seq, tail.batch, 0, [], True)
            else:
                following = Tail(tail.interval, tail.seq, tail.batch + 1, 0, [0] * len(self.spec.budgets), False)
            return self._commit(seen, kind="seal", marks=marks, tail=asdict(following))

    def rotate(self) -> int | None:
        return self.seal(rotate=True)

    def close(self) -> int | None:
        """Final seal: the tail's batch is sealed if it has rows. Closing twice does nothing."""
        return self.seal(rotate=True)

    def heartbeat(self, now_us: int | None = None) -> int:
        """Count one sign of life; an open batch of a past interval is sealed although no row arrives.

        While rows are being appended there is nothing to seal: their commit does it.
        """
        now = int(time.time() * 1e6) if now_us is None else now_us
        if self.rotation_time == "processing" and self._writing.acquire(blocking=False):
            try:
                tail = self.tail()
                if tail.open and now >= self.cycle.end(tail.interval):
                    self.seal(rotate=True)
            finally:
                self._writing.release()
        with self._beating:
            beats = json.loads(self.files.read("_heartbeat.json") or "{}").get("beats", 0) + 1
            self.files.publish("_heartbeat.json", json.dumps({"beats": beats, "at_us": now, "epoch": self.epoch}), replace=True)
        return beats

    # -- reading ----------------------------------------------------------------------------------------------------

    def _data_schema(self) -> T.StructType:
        return T.StructType(list(self.spec.spark_schema.fields) + [T.StructField("batch", T.LongType()), T.StructField("row_pos", T.LongType()), T.StructField("segment", T.LongType())])

    def partials(self, state: State) -> DataFrame:
        """Catalog rows by batch and file."""
        folders = [f"{self.path}/{state.catalog}"] * bool(state.catalog) + [f"{self.path}/_batches/{a}" for a in state.attempts]
        schema = T.StructType.fromDDL(_BATCH_ROW)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _partials_with_marks(self, state: State) -> DataFrame:
        """The same with rows for batches that hold none, and ``open`` on those in progress."""
        tail, marks = state.position, list(state.marks)
        if tail.open:
            marks.append([_packed(tail, self.cycle), tail.batch, state.tail_epoch, True])
        rows = []
        for segment, batch, epoch, is_open in marks:
            name = SegmentName.from_id(segment)
            rows.append((segment, name.start_minute * MINUTE_US, name.cycle, name.seq, batch, None, 0, None, None, None, None, epoch, None, is_open))
        parts = self.partials(state).withColumn("open", F.lit(False))
        return parts.unionAll(self.spark.createDataFrame(rows, _BATCH_ROW + ", open boolean")) if rows else parts

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A frozen view: what is committed later is never seen through it. A folder without a table has no rows to
        show, and no schema either: it is a FormatError; a table without commits is empty."""
        return Snapshot(self, self.state(version))

    def listing(self) -> list[str]:
        """Names of the visible segments, oldest first; a folder without a table lists as empty."""
        if self.files.read("spec.json") is None:
            return []
        return [r[0] for r in self.snapshot().segments().orderBy("segment_id").select("name").toLocalIterator()]

    # -- detaching and retention ------------------------------------------------------------------------------------

    def detach(self, watermark: int) -> int:
        """Hide all segments with id <= watermark from the readers of versions from now on."""
        if known_watermark(watermark) is None:
            raise ValueError("a watermark is a segment id")
        return self._commit(kind="detach", watermark=watermark)

    def detach_watermark(self) -> int | None:
        return self.state().watermark

    def reattach(self) -> int | None:
        """Show all segments again; without a watermark nothing is committed."""
        return None if self.detach_watermark() is None else self._commit(kind="detach", watermark=None)

    def retain(self, newest: int) -> list[int]:
        """Tombstone all but the newest ``newest`` segments, the open one included; returns their ids.

        Their files stay until ``vacuum``, so that pinned readers go on.
        """
        if newest < 1:
            raise ValueError("retention keeps at least one segment")
        rows = self.snapshot().segments().select("segment_id").orderBy(F.desc("segment_id")).offset(newest).collect()
        gone = sorted(r[0] for r in rows)
        for s in gone:
            log.error("retention removes segment %s", SegmentName.from_id(s))
        if gone:
            self._commit(kind="retain", tombstones=gone)
        return gone

    def vacuum(self, grace_seconds: float = 3600) -> int:
        """Delete the files of segments that were tombstoned longer ago than the grace period, and what attempts that old
        left behind without a commit (a writer that was killed); returns the number of folders."""
        state, removed = self.state(), 0
        old = [int(s) for s, at in state.tombstones.items() if time.time() - at >= grace_seconds]
        if old:
            dead = self.spark.createDataFrame([(s,) for s in old], "segment_id bigint")
            folders = self.partials(state).join(dead, "segment_id", "left_semi").select(F.regexp_extract("file", "^(.*)/[^/]*$", 1)).distinct()
            for (folder,) in folders.toLocalIterator():
                removed += self._drop(f"data/{folder}")
        named = {r[0] for r in self.partials(state).select(F.regexp_extract("file", "^commit=([^/]*)/", 1)).distinct().toLocalIterator()} | set(state.attempts)
        for folder, prefix in (("data", "commit="), ("_batches", "")):
            for name in self.files.names(folder):
                if name.removeprefix(prefix) not in named and time.time() - self.files.modified(f"{folder}/{name}") >= grace_seconds:
                    removed += self._drop(f"{folder}/{name}")
        return removed

    def _drop(self, name: str) -> int:
        there = self.files.exists(name)
        if there:
            self.files.delete(name)
        return int(there)


class Snapshot:
    """A table at one version."""

    def __init__(self, store: TableStore, state: State):
        self.store, self.state, self.version, self.spark = store, state, state.version, store.spark
        self.watermark = state.watermark

    def batches(self) -> DataFrame:
        """The catalog: one row per visible batch in the order of segments, with its bounds and whether it is sealed."""
        parts = self._visible(self.store._partials_with_marks(self.state))
        rows = parts.groupBy("segment_id", "interval_start", "cycle", "seq", "batch").agg(F.sum("row_count").alias("row_count"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"), F.min("stat_min").alias("stat_min"), F.max("stat_max").alias("stat_max"), F.max("epoch").alias("epoch"), F.max("schema_sha256").alias("schema_sha256"), F.bool_or("open").alias("open"))
        return rows.withColumn("sealed", ~F.col("open")).drop("open")

    def _visible(self, rows: DataFrame) -> DataFrame:
        gone = [(int(s),) for s in self.state.tombstones]
        if gone:
            rows = rows.join(self.spark.createDataFrame(gone, "segment_id bigint"), "segment_id", "left_anti")
        return rows if self.watermark is None else rows.where(~F.coalesce(F.col("segment_id") <= self.watermark, F.lit(False)))

    def segments(self) -> DataFrame:
        """One row per visible segment: name, rows, coverage, epoch."""
        b = self.batches().groupBy("segment_id", "interval_start", "cycle", "seq").agg(F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("batches"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"), F.max("epoch").alias("epoch"))
        return b.withColumn("name", name_column(F.floor(F.col("interval_start") / MINUTE_US), F.col("cycle"), F.col("seq")))

    def guard(self) -> None:
        """FormatError unless all visible segments have this table's schema and no batch exceeds its capacity."""
        found = self.batches().groupBy("schema_sha256").agg(F.max("row_count")).limit(3).collect()
        if {r[0] for r in found} - {self.store.spec.sha256, None}:
            raise FormatError("segments of several schemas cannot be scanned together")
        if any(r[1] > self.store.spec.batch_rows for r in found):
            raise FormatError("the catalog has a batch of more rows than its capacity")

    def prune(self, time_range: tuple[int, int] | None = None, stat_range: tuple[int, int] | None = None) -> DataFrame:
        """Batches that may hold rows within closed ranges (time in the column's own unit); open ones always stay."""
        return self.batches().where(survives(time_range, stat_range))

    def files(self, time_range: tuple[int, int] | None = None, stat_range: tuple[int, int] | None = None) -> DataFrame:
        """Files that hold surviving batches, with their segment and the first and last of these batches."""
        kept = self.prune(time_range, stat_range).select("segment_id", "batch")
        parts = self._visible(self.store.partials(self.state))
        return parts.join(kept, ["segment_id", "batch"], "left_semi").groupBy("file", "segment_id").agg(F.min("batch").alias("first"), F.max("batch").alias("last"))

    def scan(self, time_range: tuple[int, int] | None = None, stat_range: tuple[int, int] | None = None) -> DataFrame:
        """Rows of the surviving batches, filtered by the ranges, with segment, batch and row_pos.

        The catalog names the files to read. Ranges of surviving batches are pushed into Parquet beside the row filter
        and skip pages by the column index, as pages are no longer than batches. The filter always applies to rows.
        """
        self.guard()
        files = [tuple(r) for r in self.files(time_range, stat_range).toLocalIterator()]
        if not files:
            return self.spark.createDataFrame([], self.store._data_schema())
        try:
            rows = self.spark.read.schema(self.store._data_schema()).option("basePath", f"{self.store.path}/data").parquet(*[f"{self.store.path}/data/{f[0]}" for f in files]).drop("commit")
        except AnalysisException as e:
            raise FormatError(f"files of segments are missing: {str(e)[:300]}") from None
        if (time_range or stat_range) is not None:
            reach: dict[int, tuple[int, int]] = {}
            for _, s, first, last in files:
                low, high = reach.get(s, (first, last))
                reach[s] = (min(low, first), max(high, last))
            if len(reach) <= RANGES:
                near = F.lit(False)
                for s, (first, last) in reach.items():
                    near |= (F.col("segment") == s) & F.col("batch").between(first, last)
                rows = rows.where(near)
        if time_range is not None:
            column, kind = f"`{self.store.spec.time_column}`", self.store.spec.spark_schema[self.store.spec.time_column].dataType
            ends = [F.lit(v) if isinstance(kind, T.LongType) else F.timestamp_micros(F.lit(v)).cast(kind) for v in time_range]
            rows = rows.where(F.col(column).between(*ends))
        if stat_range is not None:
            rows = rows.where(F.col(f"`{self.store.spec.stats_column}`").between(*stat_range))
        return rows

    def count(self) -> int:
        """Rows, from the catalog alone."""
        return self.batches().agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]

    def null_counts(self) -> DataFrame:
        return null_counts(self.scan(), ["segment", "batch"], [c.name for c in self.store.spec.columns])

    def latest_epoch(self) -> int | None:
        """The epoch of the last segment in the order of names, whenever it was written."""
        return self.segments().agg(F.max_by("epoch", "segment_id")).first()[0]


def _packed(tail: Tail, cycle: RollCycle) -> int:
    return SegmentName(tail.interval // MINUTE_US, cycle.minutes, tail.seq).id
