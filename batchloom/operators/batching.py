"""Assignment of arriving rows to intervals, segments and batches.

Rows arrive in an order. A batch closes when it has ``batch_rows`` rows or when a row's bytes would exceed the budget of
a variable-length column, in which case the whole row opens the next batch; ``max_batches`` batches make a segment; an
interval of the roll cycle starts a new segment. All numbering restarts with the interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.cycle import RollCycle
from ..staging import stage

SLICE_ROWS = 512  # rows that look up their batch together
BROADCAST_ROWS = 100_000  # of a few numbers each, up to which a table of offsets is broadcast


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if a count finds few rows; otherwise joins shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def positions(df: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``df`` with ``pos``: the 0-based rank of each row by ``order`` inside its ``within`` group (default: overall).

    Row counts of range partitions are gathered first and give each partition its offset (a table of as many rows as
    partitions), so that neither the whole table nor a hot group ever passes through one task.
    """
    within = within or []
    # Numbers of monotonically_increasing_id: the partition in the upper bits, the row in its order in the lower 33.
    number = F.monotonically_increasing_id()
    arranged = df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order).withColumn("_number", number)
    arranged = stage(arranged, "positions").withColumn("_part", F.shiftright("_number", 33))
    counts = arranged.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_n"), F.min("_number").alias("_first"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", *within, (before - F.col("_first")).alias("_shift"))
    joined = arranged.alias("r").join(small(offsets).alias("o"), F.expr(" AND ".join(f"r.`{c}` <=> o.`{c}`" for c in ["_part", *within])))
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("_number") + F.col("_shift")).alias("pos"))


def by_row_count(pos: Column, batch_rows: int, max_batches: int | None = None) -> tuple[Column, Column, Column]:
    """(segment sequence, batch in segment, row in batch) of a 0-based position; without ``max_batches`` one segment."""
    batch = F.floor(pos / F.lit(batch_rows)).cast("bigint")
    row = F.pmod(pos, F.lit(batch_rows)).cast("bigint")
    if max_batches is None:
        return F.lit(0).cast("bigint"), batch, row
    return F.floor(batch / F.lit(max_batches)).cast("bigint"), F.pmod(batch, F.lit(max_batches)).cast("bigint"), row


def next_starts(sizes: np.ndarray, caps: list[int], batch_rows: int) -> np.ndarray:
    """For every row the row at which the batch after one that begins here would begin, ``len(sizes)`` at most.

    ``sizes``: rows x columns of byte lengths, 0 for nulls. Prefix sums and binary search find all ends at once.
    """
    n = len(sizes)
    end = np.minimum(np.arange(n) + batch_rows, n)
    for c, cap in enumerate(caps):
        upto = np.append(0, np.cumsum(sizes[:, c]))
        end = np.minimum(end, np.searchsorted(upto, upto[:-1] + cap, "right") - 1)
    return end


def first_end(sizes: np.ndarray, caps: list[int], batch_rows: int, rows: int, used: list[int]) -> int:
    """The row at which a batch ends that already holds ``rows`` rows and ``used`` bytes per column."""
    end = min(batch_rows - rows, len(sizes))
    for c, cap in enumerate(caps):
        end = min(end, int(np.searchsorted(np.append(0, np.cumsum(sizes[:, c])), cap - used[c], "right")) - 1)
    return end


def by_byte_budget(df: DataFrame, order: list[str], within: list[str], budgets: dict[str, int], batch_rows: int, carry: tuple | None = None, block_rows: int = 1 << 16) -> DataFrame:
    """``df`` with ``batch``: greedy filling by rows and by bytes of the variable-length columns, per ``within`` group.

    Greedy filling is a fold over the rows of one interval: where a batch starts depends on where the one before it did.
    It is done block by block at once. Only byte lengths travel (4 bytes a row and column). A batch that is open where a
    block begins began at one of the ``batch_rows`` rows before; for each of these a block tells at which row the batch
    begins that is open where the block ends. These tables rise in steps, and are kept as steps; composing them in order
    gives every block its entry, from which it finds its batches. Where no batch could overflow, as the longest value
    times ``batch_rows`` fits, counting rows is enough. A value that exceeds its column's budget raises; a null value
    takes no bytes; an empty table gives no rows. ``carry``: (value of the only ``within`` column, rows, bytes per
    column) of a batch that is open already; rows of that group go on in it as batch 0.
    """
    caps, columns = list(budgets.values()), list(budgets)
    ranked = positions(df, order, within)
    lengths = []
    for c, cap in budgets.items():
        size = F.coalesce(F.octet_length(f"`{c}`"), F.lit(0))
        lengths.append(F.when(size > cap, F.raise_error(F.lit(f"{c}: a value is longer than its byte budget")).cast("int")).otherwise(size).alias(f"_size{columns.index(c)}"))
    sizes = ranked.select(*within, "pos", *lengths)
    held, used = (carry[1], carry[2] or [0] * len(caps)) if carry else (0, [0] * len(caps))
    longest = sizes.agg(*[F.coalesce(F.max(f"_size{i}"), F.lit(0)) for i in range(len(caps))]).first()
    if all(n * batch_rows <= cap and u + n * (batch_rows - held) <= cap for n, cap, u in zip(longest, caps, used)):
        return ranked.withColumn("batch", F.floor((F.col("pos") + F.when(carries(f"`{within[0]}`", carry), F.lit(held)).otherwise(0)) / F.lit(batch_rows)).cast("bigint"))

    size = max(block_rows, 2 * batch_rows)
    size = -(-size // SLICE_ROWS) * SLICE_ROWS
    keyed = [df.schema[c] for c in within]
    packed = T.StructType(keyed + [T.StructField("block", T.LongType()), T.StructField("first", T.LongType()), T.StructField("sizes", T.BinaryType())])
    schema, n_within = to_arrow_schema(packed), len(within)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of consecutive positions of one group and block, with their byte lengths as 32-bit integers; the last
        rows of a block also go to the next one."""
        for b in batches:
            if not b.num_rows:
                continue
            pos = b.column("pos").to_numpy()
            new = np.append(True, pos[1:] != pos[:-1] + 1)
            for c in range(n_within):
                coded = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= coded[1:] != coded[:-1]
            at = np.flatnonzero(new)
            grid = np.stack([b.column(f"_size{i}").to_numpy() for i in range(len(caps))], axis=1).astype(np.int32)
            rows, block, blobs = [], [], []
            for x, y in zip(at.tolist(), np.append(at[1:], len(pos)).tolist()):
                for k in range(int(pos[x]) // size, (int(pos[y - 1]) + batch_rows) // size + 1):
                    lo, hi = max(x, x + k * size - batch_rows - int(pos[x])), min(y, x + (k + 1) * size - int(pos[x]))
                    if lo < hi:
                        rows.append(lo)
                        block.append(k)
                        blobs.append(grid[lo:hi].tobytes())
            rows = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(rows)) for c in range(n_within)] + [pa.array(block, pa.int64()), pa.array(pos[rows]), pa.array(blobs, pa.binary())], schema=schema)

    blocks = stage(sizes.mapInArrow(pack, packed), "byte-lengths")

    def read(t: pa.Table) -> tuple[int, int, np.ndarray]:
        """Block number, first position and byte lengths of one block's rows."""
        first = t["first"].to_numpy()
        parts = [np.frombuffer(t["sizes"][int(i)].as_py(), np.int32).reshape(-1, len(caps)).astype(np.int64) for i in np.argsort(first, kind="stable")]
        return t["block"][0].as_py(), int(first.min()), np.concatenate(parts)

    def heads(t: pa.Table, n: int) -> list[pa.ChunkedArray]:
        return [t[c].take(pa.array(np.zeros(n, np.int64))) for c in within]

    def goes_on(t: pa.Table) -> bool:
        return carry is not None and t[within[0]][0].as_py() == carry[0]

    # Rows of the open batch are named by position; -1 is the one that was open before the first row.
    stepped = T.StructType(keyed + [T.StructField(c, T.LongType()) for c in ("block", "entry", "leaves")])
    stepped_schema = to_arrow_schema(stepped)

    def steps(t: pa.Table) -> pa.Table:
        block, base, grid = read(t)
        begin = block * size - base  # rows before it belong to the block before
        if begin >= len(grid):  # nothing but the end of the block before
            return stepped_schema.empty_table()
        following = next_starts(grid, caps, batch_rows)
        leaves = np.where(following >= len(grid), np.arange(len(grid)), following)
        while (leaves[leaves] != leaves).any():
            leaves = leaves[leaves]
        entry = np.arange(begin + 1)
        change = np.flatnonzero(np.append(True, leaves[1 : begin + 1] != leaves[:begin]))
        entry, out = entry[change] + base, leaves[entry[change]] + base
        if block == 0 and goes_on(t):
            end = first_end(grid, caps, batch_rows, held, used)
            entry, out = np.append(-1, entry), np.append(-1 if end >= len(grid) else leaves[end] + base, out)
        return pa.Table.from_arrays([*heads(t, len(entry)), pa.array(np.full(len(entry), block)), pa.array(entry), pa.array(out)], schema=stepped_schema)

    entered = T.StructType(keyed + [T.StructField("block", T.LongType()), T.StructField("entry", T.LongType())])
    entered_schema = to_arrow_schema(entered)

    def compose(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("block", "ascending"), ("entry", "ascending")]))
        block, entry, leaves = (t[c].to_numpy() for c in ("block", "entry", "leaves"))
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        at, out = -1 if goes_on(t) else 0, []
        for a, b in zip(first, np.append(first[1:], len(block))):
            out.append(at)
            at = int(leaves[a + np.searchsorted(entry[a:b], at, "right") - 1])
        return pa.Table.from_arrays([*heads(t, len(first)), pa.array(block[first]), pa.array(out, pa.int64())], schema=entered_schema)

    sliced = T.StructType(keyed + [T.StructField(c, T.LongType()) for c in ("block", "slice", "seen")] + [T.StructField("starts", T.ArrayType(T.LongType()))])
    sliced_schema = to_arrow_schema(sliced)

    def walk(t: pa.Table) -> pa.Table:
        """For every slice of the block: batches begun in the block before it, and the rows at which others begin in it."""
        block, base, grid = read(t)
        at, begin, found = t["entry"][0].as_py(), block * size - base, []
        following = next_starts(grid, caps, batch_rows)
        if at < 0:
            row = first_end(grid, caps, batch_rows, held, used)
        else:
            row = at - base if at - base >= begin else int(following[at - base])
        while row < len(grid):
            found.append(row)
            row = int(following[row])
        starts = np.array(found, np.int64) + base
        slices = np.arange(block * size // SLICE_ROWS, -(-(base + len(grid)) // SLICE_ROWS))
        seen = np.searchsorted(starts, slices * SLICE_ROWS)
        ends = np.append(seen, len(starts)).astype(np.int32)
        inside = pa.ListArray.from_arrays(pa.array(ends), pa.array(starts))
        return pa.Table.from_arrays([*heads(t, len(slices)), pa.array(np.full(len(slices), block)), pa.array(slices), pa.array(seen.astype(np.int64)), inside], schema=sliced_schema)

    same = [*within, "block"]
    on = lambda a, b, names: F.expr(" AND ".join(f"{a}.`{c}` <=> {b}.`{c}`" for c in names))
    entries = blocks.groupBy(*same).applyInArrow(steps, stepped).groupBy(*within).applyInArrow(compose, entered)
    begun = blocks.alias("b").join(entries.alias("e"), on("b", "e", same)).select("b.*", "e.entry").groupBy(*same).applyInArrow(walk, sliced)
    begun = stage(begun, "batch-starts")
    of_block = begun.groupBy(*same).agg(F.sum(F.size("starts")).alias("n"))
    upto = F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = of_block.select(*same, upto.alias("before"))
    spans = begun.alias("s").join(base.alias("o"), on("s", "o", same)).select(*[F.col(f"s.`{c}`") for c in within], "slice", (F.col("before") + F.col("seen") - F.when(carries(f"s.`{within[0]}`", carry), 0).otherwise(1)).alias("open"), "starts")
    rows = ranked.withColumn("slice", F.floor(F.col("pos") / SLICE_ROWS))
    joined = rows.alias("r").join(spans.alias("s"), on("r", "s", [*within, "slice"]))
    batch = F.col("open") + F.expr("size(filter(starts, s -> s <= pos))")
    return joined.select(*[F.col(f"r.`{c}`") for c in ranked.columns], batch.cast("bigint").alias("batch"))


def carries(column: str, carry: tuple | None) -> Column:
    """Whether a row belongs to the group whose open batch goes on."""
    return F.lit(False) if carry is None else F.col(column).eqNullSafe(F.lit(carry[0]))


def model(rows: list[tuple[int, list[int]]], cycle: RollCycle, batch_rows: int, max_batches: int, caps: list[int]) -> list[tuple[int, int, int, int]]:
    """Row-at-a-time definition of the assignment, for tests: (clock, sizes) -> (interval, segment, batch, row)."""
    out: list[tuple[int, int, int, int]] = []
    interval, segment, batch, n, used = None, 0, 0, 0, [0] * len(caps)
    taken: dict[int, int] = {}
    for clock, sizes in rows:
        now = cycle.floor(clock)
        if interval is None or now != interval:
            interval, segment, batch, n, used = now, taken.get(now, 0), 0, 0, [0] * len(caps)
        elif n == batch_rows or any(u + s > c for u, s, c in zip(used, sizes, caps)):
            n, used, batch = 0, [0] * len(caps), batch + 1
            if batch == max_batches:
                segment, batch = segment + 1, 0
        taken[interval] = segment + 1
        out.append((interval, segment, batch, n))
        n += 1
        used = [u + s for u, s in zip(used, sizes)]
    return out
