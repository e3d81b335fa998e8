"""Ordered scans: a total order over range partitions, handed to numpy in chunks of bounded size.

Range partitioning on a key that ends in a unique column splits any hot entity over as many tasks as its share of the
rows needs. Operators treat every chunk as an island and report what its edges leave undecided; a second, tiny step
joins the islands. Neither the memory of a task nor its rows depend on the size of an entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_ROWS = 250_000
NULL_LONG = np.iinfo(np.int64).min


def total_order(df: DataFrame, *keys: str) -> DataFrame:
    """Range-partition by ``keys`` and sort inside each partition."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Successive tables of at least ``rows`` rows (the last may be shorter)."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def longs(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (nulls as 0) and validity of an integer column."""
    valid = pc.is_valid(column).to_numpy()
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(), valid


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of a string column without nulls, and the dictionary."""
    d = column.combine_chunks().dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where any column differs from the row before; the first row is True."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def run_bounds(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the first and the last row number of its run, given the run starts."""
    at = np.flatnonzero(starts)
    which = np.cumsum(starts) - 1
    ends = np.append(at[1:], len(starts)) - 1
    return at[which], ends[which]
