"""Implausible readings: spikes against a rolling median, stuck values and impossible values.

A *reading* is a non-null value of a field on a row whose source is not null. A *series* is the readings of one field,
source and UTC day in the order of (timestamp, row key). The scale of a source is the median absolute difference of
successive readings, zeros left out: a robust spread (median absolute deviation of the steps) that does not depend on
the price level, as a Hampel filter needs for series that drift.

A reading is bad if it is zero or below; if it lies beyond ``steps`` scales on the same side of the medians of the
readings just before and just after it; or if it belongs to a run of at least ``stuck`` equal successive readings in a
source more than half of whose successive readings differ.

One range-sorted pass over the rows decides everything but the last comparison with the source's scale and the few
readings next to a chunk's edge. It emits one row per source and chunk with a histogram of its step sizes and its
candidates (how far a reading stands off, whether it is stuck or impossible), and the edge readings; these are staged
once. Candidates are filtered inside their row when it has met its source's scale. The median step is
exact and found in two passes over the histograms: the first counts steps in buckets of one per cent, the second only
those values that lie in the bucket of a source's median, so that no task ever holds all steps of a source.

Readings are compared as 64-bit floats where medians are involved, exact up to 2**53; equality, order and runs are those
of the integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeexpr import MICROS_PER_DAY, micros
from ..staging import stage
from .batching import small
from .ordered import CHUNK_ROWS, NULL_LONG, changes, chunks, codes, longs, run_bounds, total_order

SIDE = 5
LEAST_SIDE = 3
STUCK = 15
STEPS = 20.0
EDGE = STUCK + SIDE

CANDIDATE, HISTOGRAM, EDGE_READING = 0, 1, 2

_LISTS = "steps array<double>, counts array<bigint>, keys array<bigint>, beyond array<double>, marks array<int>"
_SCAN = "kind tinyint, field int, sym string, day bigint, ts bigint, key bigint, v bigint, pos int, open int, " + _LISTS
_SCAN_ARROW = pa.schema([("kind", pa.int8()), ("field", pa.int32()), ("sym", pa.string()), ("day", pa.int64()), ("ts", pa.int64()), ("key", pa.int64()), ("v", pa.int64()), ("pos", pa.int32()), ("open", pa.int32()), ("steps", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("beyond", pa.list_(pa.float64())), ("marks", pa.list_(pa.int32()))])
IS_STUCK, IS_IMPOSSIBLE = 1, 2  # marks of a candidate
LIST = 1024  # elements of a list in one row: no row is large in memory, however large a source
BUCKETS = 64  # of step sizes, to one doubling


def _around(v: np.ndarray, series: np.ndarray, step: int) -> np.ndarray:
    """Median of the up to SIDE values before (step 1) or after (step -1) each value in its series; nan if too few."""
    n = len(v)
    near = np.full((n, SIDE), np.nan)
    for j in range(1, min(SIDE, n - 1) + 1):
        same = series[j:] == series[:-j]
        if step > 0:
            near[j:, j - 1] = np.where(same, v[:-j], np.nan)
        else:
            near[:-j, j - 1] = np.where(same, v[j:], np.nan)
    count = (~np.isnan(near)).sum(axis=1)
    near.sort(axis=1)
    rows = np.arange(n)
    low, high = near[rows, np.maximum(count - 1, 0) // 2], near[rows, np.minimum(count // 2, SIDE - 1)]
    return np.where(count >= LEAST_SIDE, (low + high) / 2, np.nan)


def _judge(v: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distance beyond both medians (0 if not on one side of both), run length, first and last row of the run."""
    value = v.astype(np.float64)
    before, after = value - _around(value, series, 1), value - _around(value, series, -1)
    with np.errstate(invalid="ignore"):
        beyond = np.where(before * after > 0, np.minimum(np.abs(before), np.abs(after)), 0.0)
    first, last = run_bounds(changes(series, v))
    return np.nan_to_num(beyond, nan=0.0, posinf=np.finfo(float).max), last - first + 1, first, last


def _steps(v: np.ndarray, series: np.ndarray, source: np.ndarray, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histogram (source code, step, count) of the absolute differences of successive readings of a series."""
    same = series[1:] == series[:-1]
    if joined is not None:
        same &= joined
    a, b = v[1:][same], v[:-1][same]
    step = np.where(a == b, 0.0, np.maximum(np.abs(a.astype(np.float64) - b.astype(np.float64)), 1.0))
    code = source[1:][same]
    order = np.lexsort((step, code))
    code, step = code[order], step[order]
    starts = np.flatnonzero(changes(code, step)) if len(code) else np.empty(0, int)
    return code[starts], step[starts], np.diff(np.append(starts, len(code)))


def _list_starts(source: np.ndarray) -> np.ndarray:
    """First elements of lists that hold one source each, and not more than LIST elements."""
    first, _ = run_bounds(changes(source))
    return np.flatnonzero((np.arange(len(source)) - first) % LIST == 0)


def _rows(kind: int, field: np.ndarray, sym: pa.Array, **columns: np.ndarray) -> pa.RecordBatch:
    n = len(sym)
    data = {"kind": pa.array(np.full(n, kind, np.int8)), "field": pa.array(field.astype(np.int32)), "sym": sym.cast(pa.string())}
    data |= {k: c if isinstance(c, pa.Array) else pa.array(c) for k, c in columns.items()}
    return pa.RecordBatch.from_arrays([data[f.name].cast(f.type) if f.name in data else pa.nulls(n, f.type) for f in _SCAN_ARROW], schema=_SCAN_ARROW)


def _scan(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches, chunk_rows):
        src, _ = longs(t["src"])
        code, names = codes(t["sym"])
        ts, ts_ok = longs(t["ts"])
        key, key_ok = longs(t["key"])
        day = np.where(ts_ok, ts // MICROS_PER_DAY, NULL_LONG)
        row_series = np.cumsum(changes(src, code, day)) - 1
        for k in (0, 1):
            values, ok = longs(t[f"v{k}"])
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            v, series = values[at], row_series[at]
            field = src[at] * 2 + k
            beyond, run, run_first, run_last = _judge(v, series)
            s_first, s_last = run_bounds(changes(series))
            i = np.arange(len(at))
            open_left, open_right = series == 0, series == row_series[-1]
            undecided = (open_left & (i - s_first < SIDE)) | (open_right & (s_last - i < SIDE))
            undecided |= (run < STUCK) & ((open_left & (run_first == s_first)) | (open_right & (run_last == s_last)))
            # A usual step is at least 1, so that a smaller distance can be dropped at once.
            found = ~undecided & ((v <= 0) | (beyond > STEPS) | (run >= STUCK))
            if found.any():
                f = at[found]
                c = field[found] * len(names) + code[f]
                at_source = _list_starts(c)
                ends = pa.array(np.append(at_source, len(c)).astype(np.int32))
                marks = (run[found] >= STUCK) * IS_STUCK + (v[found] <= 0) * IS_IMPOSSIBLE
                lists = {"keys": pa.array(key[f], mask=~key_ok[f]), "beyond": pa.array(beyond[found]), "marks": pa.array(marks.astype(np.int32))}
                yield _rows(CANDIDATE, c[at_source] // len(names), names.take(pa.array(c[at_source] % len(names))), **{k: pa.ListArray.from_arrays(ends, values) for k, values in lists.items()})
            keyed = field * len(names) + code[at]
            c, step, n = _steps(v, series, keyed)
            if len(c):
                at_source = _list_starts(c)
                ends = pa.array(np.append(at_source, len(c)).astype(np.int32))
                lists = {k: pa.ListArray.from_arrays(ends, pa.array(values)) for k, values in (("steps", step), ("counts", n))}
                yield _rows(HISTOGRAM, c[at_source] // len(names), names.take(pa.array(c[at_source] % len(names))), **lists)
            edge = (open_left & (i - s_first < EDGE)) | (open_right & (s_last - i < EDGE))
            f = at[edge]
            yield _rows(EDGE_READING, field[edge], names.take(pa.array(code[f])), day=day[f], ts=np.where(ts_ok[f], ts[f], NULL_LONG), key=pa.array(key[f], mask=~key_ok[f]), v=v[edge], pos=(i - s_first)[edge], open=undecided[edge].astype(np.int32))


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decide the edge readings of one series: chunks that follow one another are joined, gaps inside a chunk cut."""
    pdf = pdf.sort_values(["ts", "key"], na_position="first", kind="stable")
    pos, v = pdf["pos"].to_numpy(), pdf["v"].to_numpy(np.int64)
    joined = (pos[1:] == 0) | (pos[1:] == pos[:-1] + 1)
    stretch = np.cumsum(np.append(True, ~joined)) - 1
    beyond, run, _, _ = _judge(v, stretch)
    found = (pdf["open"].to_numpy() == 1) & ((v <= 0) | (beyond > STEPS) | (run >= STUCK))
    _, step, n = _steps(v, stretch, np.zeros(len(v), np.int64), pos[1:] == 0)
    marks = (run[found] >= STUCK) * IS_STUCK + (v[found] <= 0) * IS_IMPOSSIBLE
    keys = [None if pd.isna(k) else int(k) for k in pdf["key"][found]]
    return pd.DataFrame({"field": [pdf["field"].iloc[0]], "sym": [pdf["sym"].iloc[0]], "steps": [step], "counts": [n], "keys": [keys], "beyond": [beyond[found]], "marks": [marks.astype(np.int32)]})


def bad_readings(sources: list[tuple[DataFrame, str, str, str, list[str]]], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Bad readings of several tables.

    ``sources``: (table, source column, timestamp column, row key column, one or two integer fields) each. Returns
    ``tbl`` (position in the list), ``field`` (position among the fields), ``row_key`` and the three reasons
    ``impossible``, ``spike``, ``stuck`` as booleans.

    Defined cases: rows with null source are left out, null values are no readings. Readings with null timestamp form
    a series of their own, ordered by key. Without a non-zero step, no reading is a spike. Empty tables give no rows;
    extra columns are never read. Two rows with one timestamp are ordered by row key.
    """
    rows = None
    for i, (df, sym, ts, key, fields) in enumerate(sources):
        values = [F.col(f).cast("bigint") for f in fields] + [F.lit(None).cast("bigint")] * (2 - len(fields))
        part = df.where(F.col(sym).isNotNull()).select(F.lit(i).cast("int").alias("src"), F.col(sym).alias("sym"), micros(ts, df.schema[ts].dataType).alias("ts"), F.col(key).cast("bigint").alias("key"), values[0].alias("v0"), values[1].alias("v1"))
        part = part.where(F.col("v0").isNotNull() | F.col("v1").isNotNull())
        rows = part if rows is None else rows.unionAll(part)
    scanned = stage(total_order(rows, "src", "sym", "ts", "key").mapInArrow(lambda batches: _scan(batches, chunk_rows), _SCAN), "spikes")

    lists = ["field", "sym", "steps", "counts", "keys", "beyond", "marks"]
    stitched = (
        scanned.where(F.col("kind") == EDGE_READING)
        .select("field", "sym", "day", "ts", "key", "v", "pos", "open")
        .groupBy("field", "sym", "day")
        .applyInPandas(_stitch, "field int, sym string, " + _LISTS)
    )
    stitched = stage(stitched, "spikes-edges")
    both = scanned.where(F.col("kind") != EDGE_READING).select(lists).unionAll(stitched)

    pairs = F.explode(F.arrays_zip("steps", "counts")).alias("p")
    steps = both.where("steps IS NOT NULL").select("field", "sym", pairs).select("field", "sym", F.col("p.steps").alias("x"), F.col("p.counts").alias("n"))
    bucket = F.when(F.col("x") > 0, F.floor(F.log2("x") * BUCKETS).cast("int")).otherwise(-1).alias("bucket")
    source = Window.partitionBy("field", "sym")
    coarse = steps.groupBy("field", "sym", bucket).agg(F.sum("n").alias("n"))
    moved = F.when(F.col("bucket") >= 0, F.col("n")).otherwise(0)
    coarse = stage(coarse.select("field", "sym", "bucket", "n", moved.alias("m"), (F.sum(moved).over(source.orderBy("bucket")) - moved).alias("before"), F.sum(moved).over(source).alias("all"), F.sum("n").over(source).alias("pairs")), "spikes-buckets")
    # The middle two of all non-zero steps: the first with a running count of at least, and of more than, half.
    middle = coarse.where("m > 0 AND ((2 * before < all AND 2 * (before + m) >= all) OR (2 * before <= all AND 2 * (before + m) > all))")
    fine = steps.withColumn("bucket", bucket).join(small(middle.select("field", "sym", "bucket", "before", "all")), ["field", "sym", "bucket"]).groupBy("field", "sym", "bucket", "before", "all", "x").agg(F.sum("n").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("field", "sym", "bucket").orderBy("x"))
    fine = fine.select("field", "sym", "x", "all", upto.alias("upto"))
    step = fine.groupBy("field", "sym").agg(((F.min(F.expr("CASE WHEN 2 * upto >= all THEN x END")) + F.min(F.expr("CASE WHEN 2 * upto > all THEN x END"))) / 2).alias("step"))
    lively = coarse.groupBy("field", "sym").agg((2 * F.max("all") > F.max("pairs")).alias("lively"))
    scale = lively.join(step, ["field", "sym"], "left")
    spike = F.lit(STEPS) * F.col("step")
    candidates = both.where("keys IS NOT NULL").join(small(scale), ["field", "sym"], "left")
    bad = lambda c: (c["marks"].bitwiseAND(IS_IMPOSSIBLE) > 0) | F.coalesce(c["beyond"] > spike, F.lit(False)) | ((c["marks"].bitwiseAND(IS_STUCK) > 0) & F.coalesce("lively", F.lit(False)))
    kept = candidates.select("field", "step", "lively", F.explode(F.filter(F.arrays_zip("keys", "beyond", "marks"), bad)).alias("c"))
    judged = kept.select(
        F.floor(F.col("field") / 2).cast("int").alias("tbl"),
        (F.col("field") % 2).alias("field"),
        F.col("c.keys").alias("row_key"),
        (F.col("c.marks").bitwiseAND(IS_IMPOSSIBLE) > 0).alias("impossible"),
        F.coalesce(F.col("c.beyond") > spike, F.lit(False)).alias("spike"),
        ((F.col("c.marks").bitwiseAND(IS_STUCK) > 0) & F.coalesce("lively", F.lit(False))).alias("stuck"),
    )
    return judged
