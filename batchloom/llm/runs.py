"""Repeated consecutive events: collapse each run into one row with its ends, count and duration.

A state machine walks over the events of each entity in order and closes a run when the next event is too late or too
different from the one before it. It runs over a range-sorted total order in chunks, each chunk on its own; runs that
touch a chunk's edge come out open, with the events at their ends, and a window over the few open runs of an entity
joins those that continue one another. A hot entity therefore spreads over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeexpr import micros
from ..operators.ordered import CHUNK_ROWS, changes, chunks, codes, longs, total_order
from ..staging import stage


def _same(value: np.ndarray, ok: np.ndarray, tolerance: int) -> np.ndarray:
    """Whether each row after the first is within tolerance of the row before; a null equals only a null."""
    a, b = value[1:], value[:-1]
    # The difference of two longs may overflow: compare as unsigned distance.
    distance = np.where(a >= b, a.astype(np.uint64) - b.astype(np.uint64), b.astype(np.uint64) - a.astype(np.uint64))
    return np.where(ok[1:] & ok[:-1], distance <= np.uint64(tolerance), ok[1:] == ok[:-1])


def _machine(batches: Iterator[pa.RecordBatch], n_values: int, gap: int, tolerance: int, chunk_rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches, chunk_rows):
        code, names = codes(t["entity"])
        ts, _ = longs(t["ts"])
        new = changes(code)
        go = ~new[1:] & (ts[1:] - ts[:-1] <= gap)
        for k in range(n_values):
            go &= _same(*longs(t[f"v{k}"]), tolerance)
        new[1:] = ~go
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        n = last - first + 1
        edge = (first == 0) | (last == len(new) - 1)
        keep = (n > 1) | edge
        first, last, n = first[keep], last[keep], n[keep]
        out = {"entity": names.take(pa.array(code[first])), "n": pa.array(n), "left": pa.array(first == 0), "right": pa.array(last == len(new) - 1)}
        for side, at in (("first", first), ("last", last)):
            for c in ("ts", "key", *[f"v{k}" for k in range(n_values)]):
                out[f"{side}_{c}"] = t[c].take(pa.array(at)).combine_chunks()
        yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)


def collapse_runs(df: DataFrame, entity: str, ts: str, key: str, values: list[str], gap_seconds: float = 60, tolerance: int = 2, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per run of at least two events: entity, first_key, last_key, first_ts, last_ts (microseconds), n, seconds.

    An event continues the run of the event before it (by ``ts``, then ``key``) if it follows by at most
    ``gap_seconds`` and each of the integer ``values`` differs from that event's by at most ``tolerance``.

    Defined cases: rows with null entity, timestamp or key are left out; a null value equals only a null; repeated
    rows are events like any other; an empty table gives no rows; extra columns are never read.
    """
    gap = round(gap_seconds * 1_000_000)
    cols = [F.col(entity).alias("entity"), micros(ts, df.schema[ts].dataType).alias("ts"), F.col(key).cast("bigint").alias("key")]
    cols += [F.col(v).cast("bigint").alias(f"v{k}") for k, v in enumerate(values)]
    rows = df.select(*cols).where("entity IS NOT NULL AND ts IS NOT NULL AND key IS NOT NULL")
    ends = [f"{side}_{c}" for side in ("first", "last") for c in ("ts", "key", *[f"v{k}" for k in range(len(values))])]
    ddl = "entity string, n bigint, `left` boolean, `right` boolean, " + ", ".join(f"{c} bigint" for c in ends)
    schema = pa.schema([("entity", pa.string()), ("n", pa.int64()), ("left", pa.bool_()), ("right", pa.bool_()), *[(c, pa.int64()) for c in ends]])
    count = len(values)
    found = total_order(rows, "entity", "ts", "key").mapInArrow(lambda b: _machine(b, count, gap, tolerance, chunk_rows, schema), ddl)

    # Open runs are at most two a chunk; closed ones pass through the same window as runs of their own, but as they
    # would bring a hot entity into one task, they are taken around it.
    staged = stage(found, "runs")
    shown = ["entity", "first_key", "last_key", "first_ts", "last_ts", "n"]
    closed = staged.where("NOT `left` AND NOT `right`").select(shown)
    order = Window.partitionBy("entity").orderBy("first_ts", "first_key")
    linked = F.lag("right").over(order) & F.col("left") & (F.col("first_ts") - F.lag("last_ts").over(order) <= gap)
    for k in range(count):
        a, b = F.lag(f"last_v{k}").over(order), F.col(f"first_v{k}")
        near = F.abs(a.cast("decimal(20,0)") - b.cast("decimal(20,0)")) <= tolerance
        linked &= (a.isNull() & b.isNull()) | F.coalesce(near, F.lit(False))
    chained = staged.where("`left` OR `right`").withColumn("new", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
    chained = chained.withColumn("run", F.sum("new").over(order))
    by_time = F.struct("first_ts", "first_key")
    joined = chained.groupBy("entity", "run").agg(
        F.min_by("first_key", by_time).alias("first_key"), F.max_by("last_key", by_time).alias("last_key"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n")
    )
    runs = closed.unionAll(joined.where("n > 1").select(shown))
    return runs.withColumn("seconds", (F.col("last_ts") - F.col("first_ts")) / F.lit(1e6))
