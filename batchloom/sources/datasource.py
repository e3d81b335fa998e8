"""SQL access: a Python data source over a table store, pruned by the catalog.

``register(spark)`` makes ``spark.read.format("batchloom").option("path", folder).load()`` and SQL over it available and
turns on ``spark.sql.python.filterPushdown.enabled``, without which Spark refuses readers that take filters; a session
that must leave it off reads with ``.option("pushdown", "false")``. The store's own ``scan`` is the faster route, as
Spark's Parquet reader stays inside the JVM; this one exists for plain SQL.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import FormatError
from .log import state_at
from .spec import TableSpec


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentSource)


class SegmentSource(DataSource):
    """Tables on a file system that every executor mounts."""

    @classmethod
    def name(cls) -> str:
        return "batchloom"

    def _root(self) -> str:
        return self.options["path"].removeprefix("file://").rstrip("/")

    def _spec(self) -> TableSpec:
        with open(f"{self._root()}/spec.json") as f:
            return TableSpec.from_json(f.read())

    def schema(self):
        return self._spec().spark_schema

    def reader(self, schema) -> DataSourceReader:
        kind = SegmentReader if self.options.get("pushdown", "true").lower() == "false" else PruningReader
        return kind(self._root(), self._spec(), schema)


@dataclass
class BatchRange(InputPartition):
    """The batches of one file that may hold matching rows."""

    path: str
    first: int
    last: int


class SegmentReader(DataSourceReader):
    def __init__(self, root: str, spec: TableSpec, schema):
        self.root, self.spec, self.out = root, spec, schema
        self.bounds: dict[str, list] = {}

    def _text(self, name: str) -> str | None:
        path = f"{self.root}/{name}"
        if not os.path.exists(path):
            return None
        with open(path) as f:
            return f.read()

    def partitions(self) -> list[BatchRange]:
        """One per file with surviving batches: segments that are detached or tombstoned are left out, and batches of
        which the catalog knows that they cannot match."""
        names = os.listdir(f"{self.root}/_log") if os.path.isdir(f"{self.root}/_log") else []
        state = state_at(names, self._text, self.spec.sha256)
        folders = [state.catalog] * bool(state.catalog) + [f"_batches/{a}" for a in state.attempts]
        columns = ["segment_id", "batch", "file", "ts_min", "ts_max", "stat_min", "stat_max", "schema_sha256"]
        parts = [ds.dataset(f"{self.root}/{f}", format="parquet").to_table(columns=columns) for f in folders]
        if not parts:
            return []
        rows = pa.concat_tables(parts)
        if set(rows["schema_sha256"].unique().to_pylist()) - {self.spec.sha256}:
            raise FormatError("segments of several schemas cannot be scanned together")
        keep = pc.invert(pc.is_in(rows["segment_id"], pa.array([int(s) for s in state.tombstones], pa.int64())))
        if state.watermark is not None:
            keep = pc.and_(keep, pc.greater(rows["segment_id"], state.watermark))
        for column, (low, high) in self.bounds.items():
            for name in [n for n, c in (("ts", self.spec.time_column), ("stat", self.spec.stats_column)) if c == column]:
                # Null bounds are those of a batch without values, which no comparison matches.
                if low is not None:
                    keep = pc.and_(keep, pc.fill_null(pc.greater_equal(rows[f"{name}_max"], pa.scalar(low).cast(rows.schema.field(f"{name}_max").type)), False))
                if high is not None:
                    keep = pc.and_(keep, pc.fill_null(pc.less_equal(rows[f"{name}_min"], pa.scalar(high).cast(rows.schema.field(f"{name}_min").type)), False))
        reach = rows.filter(keep).group_by("file").aggregate([("batch", "min"), ("batch", "max")])
        return [BatchRange(f"{self.root}/data/{f}", a, b) for f, a, b in sorted(zip(*(reach[c].to_pylist() for c in ("file", "batch_min", "batch_max"))))]

    def read(self, partition: BatchRange):
        arrow = to_arrow_schema(self.out)
        within = (ds.field("batch") >= partition.first) & (ds.field("batch") <= partition.last)
        for batch in ds.dataset(partition.path, format="parquet").to_batches(columns=arrow.names, filter=within):
            yield batch.cast(arrow)


class PruningReader(SegmentReader):
    """Takes filters; a batch is open or sealed alike here, as every row of a commit is covered by its bounds."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Remember bounds on the time and stats columns; every filter stays with Spark as well, as pruning is coarse."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column in (self.spec.time_column, self.spec.stats_column):
                low, high = self.bounds.setdefault(column, [None, None])
                value = _whole(f.value) if hasattr(f, "value") else None
                if value is not None and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = value if low is None else max(low, value)
                if value is not None and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = value if high is None else min(high, value)
                self.bounds[column] = [low, high]
            yield f


def _whole(value: object) -> int | None:
    """A bound as the catalog counts: integers as they are, instants in microseconds; None for what has no such form."""
    if isinstance(value, datetime):
        instant = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return (instant - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return value if type(value) is int else None
