"""Percentiles of very large columns by deterministic buffer collapsing, with a tracked error bound.

A summary is a set of sorted buffers, each of at most ``size`` values of one weight (a power of two). Two full buffers
of one weight are collapsed into one of twice the weight: their values are merged and every second one is kept, from an
even or an odd position. A collapse of weight w from an odd position lowers the rank of a value by at most w, one from an
even position raises it by at most w. Every summary carries both sums, ``under`` and ``over``, and each collapse takes
the side with the smaller one, so that the larger, the bound of the rank error, is half of all weights collapsed. Until a
group has more than ``size`` values its summary is exact. Summaries merge in any grouping, by partition, day or batch, in
a tree. ``buffer_size`` gives the size for a stated error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..staging import stage

EPSILON, MOST_ROWS = 1e-4, 10**9  # rank error as a share of the rows, of a group of so many rows
FAN_IN = 32


def buffer_size(epsilon: float = EPSILON, rows: int = MOST_ROWS) -> int:
    """The smallest power of two as buffer size for which a group of ``rows`` values has a bound of ``epsilon`` x rows.

    On each level values of weight w take part in rows / (2 size w) collapses, which add rows / (2 size) in all, half of
    it on either side; there are log2(rows / size) levels.
    """
    size = 1
    while size < rows and np.log2(rows / size) / (4 * size) > epsilon:
        size *= 2
    return size


SIZE = buffer_size()


class Summary:
    """Sorted buffers by level (weight 2**level), with the count of values and the rank errors so far."""

    def __init__(self, size: int):
        self.size, self.n, self.under, self.over = size, 0, 0, 0
        self.loose = np.empty(0, np.int64)  # values of weight 1 that fill no buffer yet
        self.levels: dict[int, list[np.ndarray]] = {}

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        values = np.concatenate([self.loose, values])
        full = len(values) // self.size * self.size
        for i in range(0, full, self.size):
            self._push(0, np.sort(values[i : i + self.size]))
        self.loose = values[full:]

    def _push(self, level: int, buffer: np.ndarray) -> None:
        held = self.levels.setdefault(level, [])
        held.append(buffer)
        if len(held) > 1:
            a, b = held
            self.levels[level] = []
            merged = np.sort(np.concatenate([a, b]), kind="stable")
            odd = self.under < self.over
            self.under, self.over = self.under + (odd << level), self.over + ((not odd) << level)
            self._push(level + 1, merged[odd::2])

    @property
    def error(self) -> int:
        return max(self.under, self.over)

    def merge(self, n: int, under: int, over: int, levels: list[int], sizes: list[int], values: np.ndarray) -> None:
        self.under, self.over = self.under + under, self.over + over
        at = 0
        for level, size in zip(levels, sizes):
            part = values[at : at + size]
            at += size
            if level < 0:
                self.add(part)
                self.n -= len(part)
            else:
                self._push(level, part)
        self.n += n

    def parts(self) -> tuple[list[int], list[int], np.ndarray]:
        out = [(-1, self.loose)] * bool(len(self.loose)) + [(level, b) for level, held in sorted(self.levels.items()) for b in held]
        return [p[0] for p in out], [len(p[1]) for p in out], np.concatenate([p[1] for p in out]) if out else np.empty(0, np.int64)


def quantile_values(levels: list[int], sizes: list[int], values: np.ndarray, n: int, probabilities: list[float]) -> list[int | None]:
    """For each probability p the value at rank ceil(p n), at least 1, of the weighted values."""
    if not n:
        return [None] * len(probabilities)
    weights = np.repeat([1 << max(level, 0) for level in levels], sizes)
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    ranks = [max(1, int(np.ceil(round(p * n, 9)))) for p in probabilities]
    return [int(values[order[min(np.searchsorted(upto, r), len(values) - 1)]]) for r in ranks]


_SUMMARY = "n bigint, under bigint, over bigint, levels array<int>, sizes array<int>, vals array<bigint>"
_COLUMNS = ["n", "under", "over", "levels", "sizes", "vals"]


def _batch(keys: pa.Table, summaries: list[Summary], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    parts = [s.parts() for s in summaries]
    columns = [keys[c].combine_chunks() for c in keys.column_names]
    columns += [pa.array([getattr(s, c) for s in summaries], pa.int64()) for c in _COLUMNS[:3]]
    columns += [pa.array([p[0] for p in parts], pa.list_(pa.int32())), pa.array([p[1] for p in parts], pa.list_(pa.int32())), pa.array([p[2] for p in parts], pa.list_(pa.int64()))]
    yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=256)


def summarise(df: DataFrame, keys: list[str], value: str, size: int = SIZE) -> DataFrame:
    """Partial summaries of the non-null integers ``value`` per ``keys``, at most one per key and input partition.

    No shuffle takes place. Columns: keys, ``n``, ``under``, ``over``, ``levels``, ``sizes``, ``vals``. The memory of a task is
    bounded by its partition, and for one key by ``size`` x log(rows). Keys may be null and then form a group.
    """
    rows = df.select(*[F.col(k) for k in keys], F.col(value).cast("bigint").alias("_v")).where("_v IS NOT NULL")
    fields = [f for f in rows.schema.fields if f.name != "_v"]
    out = T.StructType(fields + list(T.StructType.fromDDL(_SUMMARY).fields))
    schema = to_arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Summary] = {}
        examples: dict[tuple, dict] = {}

        def absorb(t: pa.Table) -> None:
            coded, lists = [], []
            for k in keys:
                d = t[k].combine_chunks().dictionary_encode(null_encoding="encode")
                d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
                coded.append(d.indices.to_numpy(zero_copy_only=False))
                lists.append(d.dictionary.to_pylist())
            order = np.lexsort(coded[::-1])
            sorted_codes = [c[order] for c in coded]
            v = t["_v"].to_numpy()[order]
            new = np.ones(len(v), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_codes])
            at = np.flatnonzero(new)
            for a, b in zip(at, np.append(at[1:], len(v))):
                key = tuple(names[c[a]] for names, c in zip(lists, sorted_codes))
                s = held.get(key)
                if s is None:
                    s = held[key] = Summary(size)
                    examples[key] = dict(zip(keys, key))
                s.add(v[a:b])

        waiting, count = [], 0
        for b in batches:
            if b.num_rows:
                waiting.append(b)
                count += b.num_rows
            if count >= 250_000:
                absorb(pa.Table.from_batches(waiting))
                waiting, count = [], 0
        if count:
            absorb(pa.Table.from_batches(waiting))
        if held:
            names = pa.Table.from_pylist(list(examples.values()), schema=pa.schema([schema.field(k) for k in keys]))
            yield from _batch(names, list(held.values()), schema)

    return rows.mapInArrow(scan, out)


def combine(summaries: DataFrame, keys: list[str], size: int = SIZE, fan_in: int = FAN_IN, per_key: int | None = None) -> DataFrame:
    """One summary per ``keys``, merged in a tree.

    Each round merges about ``fan_in`` summaries of a key in one task, so that a key with a summary in every partition
    (or day) never gathers in one place; the rounds are the logarithm of ``per_key``, the most summaries that a key may
    have (default: one a partition). The order of merging follows the summaries' content, so that results repeat.
    """
    labels, columns = [c for c in summaries.columns if c not in (*keys, *_COLUMNS)], _COLUMNS
    part = summaries.withColumn("_part", F.spark_partition_id())
    if per_key is None:  # what a task made of its partition is written once, and tells how many there are
        part = stage(part, "summaries")
        per_key = 1 + part.agg(F.coalesce(F.max("_part"), F.lit(0))).first()[0]
    lanes = -(-per_key // fan_in)
    part = part.select(*keys, *columns, F.hash("_part", *[F.col(c) for c in labels]).alias("_lane"))
    out = T.StructType([summaries.schema[k] for k in keys] + [T.StructField("_lane", T.IntegerType())] + list(T.StructType.fromDDL(_SUMMARY).fields))
    schema, groups = to_arrow_schema(out), [*keys, "_lane"]
    tasks = int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[tuple, Summary]] = []
        for b in batches:
            heads = list(zip(*[b.column(c).to_pylist() for c in groups]))
            n, under, over = (b.column(c).to_pylist() for c in columns[:3])
            levels, sizes = b.column("levels").to_pylist(), b.column("sizes").to_pylist()
            ends = b.column("vals").offsets.to_numpy() - b.column("vals").offsets[0].as_py()
            values = b.column("vals").flatten().to_numpy()
            for i, head in enumerate(heads):
                if not done or done[-1][0] != head:
                    if len(done) >= 256:
                        yield from flush(done)
                        done = []
                    done.append((head, Summary(size)))
                done[-1][1].merge(n[i], under[i], over[i], levels[i], sizes[i], values[ends[i] : ends[i + 1]])
        if done:
            yield from flush(done)

    def flush(done: list[tuple[tuple, Summary]]) -> Iterator[pa.RecordBatch]:
        heads = pa.table({c: pa.array([d[0][i] for d in done], schema.field(c).type) for i, c in enumerate(groups)})
        yield from _batch(heads, [d[1] for d in done], schema)

    while True:
        lane = F.pmod(F.col("_lane"), F.lit(lanes)).cast("int").alias("_lane")
        rows = part.select(*keys, *columns, lane, F.xxhash64("vals").alias("_order"))
        # A fixed number of tasks: the work lies in merging, not in bytes. Summaries of one group arrive in order.
        part = rows.repartition(tasks, *groups).sortWithinPartitions(*groups, "n", "under", "over", "_order").mapInArrow(merge, out)
        if lanes == 1:
            return part.drop("_lane")
        lanes = -(-lanes // fan_in)


def quantiles(summaries: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """keys, n, error (bound of the rank error, in ranks) and q (values in the order of ``probabilities``)."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def read(levels: pd.Series, sizes: pd.Series, vals: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([quantile_values(list(a), list(b), np.asarray(c, np.int64), int(d), probabilities) for a, b, c, d in zip(levels, sizes, vals, n)])

    return summaries.select(*keys, "n", F.greatest("under", "over").alias("error"), read("levels", "sizes", "vals", "n").alias("q"))
