"""Long exact spans that stand in more than one record.

Seeds are short k-mers chosen by content (the smallest hash among the k-mers of every stretch of ``length`` code
points), so that two records with a common stretch choose the same seed in it. The stretches that choose one seed
occurrence form a run, a piece of text of at most ``2 * length - k`` code points. Seeds are joined across records in three
steps, none of which pairs the holders of a seed:

1. One row per run, with the hashes of its seed and of its whole text, is sorted by seed and text. Records that hold the
   same run share all of its stretches. Runs whose seed stands in no other record share none.
2. The runs left open (same seed, other surroundings: mostly the two ends of a passage), with one copy of each settled
   run of their seed, are cut out of their texts, and their stretches are compared, inside one seed, by hash.
3. Shared stretches that overlap or touch are united. For verbatim spans the gap cost of a chain is forbidding, so that
   chaining is an interval union.

Hot seeds are spread: what two records of one task share is decided on the spot and told to the others by one copy
(map-side combine), runs of a seed that is frequent in a task are sent by their text instead of their seed, and the open
runs of a seed with many of them are sent stretch by stretch. Groups are walked through in sorted order with a state of
bounded size and are never held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..staging import stage

LENGTH = 100
SEED = 40
CHUNK_POINTS = 2_000_000
FREQUENT = 16  # runs of one seed in a chunk from which on they are sent by their text
OPEN_ROWS = 4_096  # open runs of one seed from which on they are sent stretch by stretch

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that looks random."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


class Flat:
    """Texts one after another as code points, with rolling hashes of any length."""

    def __init__(self, texts: list[str]):
        size = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.text = np.repeat(np.arange(len(texts)), size)
        self.n = len(points)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(points) * _powers(_BASE, self.n)[: self.n], out=self.sums[1:])
        self.inverse = _powers(_INVERSE, self.n)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` code points from each position."""
        return mix((self.sums[at + length] - self.sums[at]) * self.inverse[at])

    def windows(self, length: int) -> np.ndarray:
        """Positions from which ``length`` code points fit into their text."""
        at = np.arange(self.n)
        return at[at + length <= self.end[self.text]] if self.n else at


def seeds(flat: Flat, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window position the position and hash of its seed: the leftmost k-mer of smallest hash in it."""
    if not len(at):
        return at, np.empty(0, np.uint64)
    width = length - k + 1
    m = flat.n - k + 1
    position = np.arange(m)
    key = flat.hashes(position, k)
    every = key
    reach = 1
    while 2 * reach <= width:
        a, b = key[: len(key) - reach], key[reach:]
        right = b < a
        position = np.where(right, position[reach:], position[: len(position) - reach])
        key = np.where(right, b, a)
        reach *= 2
    far = at + width - reach
    right = key[far] < key[at]
    chosen = np.where(right, position[far], position[at])
    return chosen, every[chosen]


def _runs(*same: np.ndarray, step: np.ndarray) -> np.ndarray:
    """First rows of runs in which ``same`` columns repeat and ``step`` rises by one."""
    if not len(step):
        return np.empty(0, np.int64)
    new = np.append(True, step[1:] != step[:-1] + 1)
    for c in same:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _pieces(batches: Iterator[pa.RecordBatch], overlap: int, points: int = CHUNK_POINTS) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Chunks of about ``points`` code points: ids, offset of each piece in its text, and pieces.

    A longer text comes in pieces that overlap so far that every window lies in one of them.
    """
    ids, base, parts, held = [], [], [], 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(size > overlap).tolist():  # others are too short for any window
            text = batch.column(1)[i].as_py()
            for at in range(0, max(1, len(text) - overlap), points):
                ids.append(batch.column(0)[i].as_py())
                base.append(at)
                parts.append(text[at : at + points + overlap])
                held += len(parts[-1])
                if held >= points:
                    yield np.array(ids, np.int64), np.array(base, np.int64), parts
                    ids, base, parts, held = [], [], [], 0
    if held:
        yield np.array(ids, np.int64), np.array(base, np.int64), parts


def _groups(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, first row of each group in it, and whether the group has two different documents."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], docs[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    return order, first, np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(h) else np.empty(0, bool)


# Of a run: its text is known to stand in another record; all is decided; it only tells that its seed is shared; its seed
# is; it is no row of the table but what is remembered of rows before.
KNOWN, DECIDED, MARK, SPREAD, MEMORY = 1, 2, 4, 8, 16
_RUNS = "cell bigint, run bigint, seed bigint, id bigint, start bigint, n int, state int"
_RUNS_ARROW = pa.schema([(c, pa.int64()) for c in ("cell", "run", "seed", "id", "start")] + [("n", pa.int32()), ("state", pa.int32())])


def _columns(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def runs_of(ids: np.ndarray, base: np.ndarray, parts: list[str], length: int, k: int) -> pa.RecordBatch | None:
    """Rows (see _RUNS) of one chunk's runs: all that two of its records share is decided here and sent once."""
    flat = Flat(parts)
    at = flat.windows(length)
    where, seed = seeds(flat, at, length, k)
    if not len(at):
        return None
    first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
    n = np.diff(np.append(first, len(at)))
    at, where, seed = at[first], where[first], seed[first]
    run = mix(flat.hashes(at, n + length - 1) ^ mix((where - at) << 32 | n))
    piece = flat.text[at]
    doc, start = ids[piece], at - flat.begin[piece] + base[piece]
    order, first, shared = _groups(run, doc)
    local = np.empty(len(at), bool)
    local[order] = np.repeat(shared, np.diff(np.append(first, len(at))))
    send = ~local
    send[order[first[shared]]] = True
    _, which, count = np.unique(seed[send], return_inverse=True, return_counts=True)
    many = np.zeros(len(at), bool)
    many[send] = count[which] > FREQUENT
    mark = np.flatnonzero(many)[np.unique(seed[many], return_index=True)[1]]
    zero = lambda rows: np.zeros(len(rows), np.int64)
    cell = np.where(many, mix(run), seed)
    out = [
        (mix(doc[local]), run[local], seed[local], doc[local], start[local], n[local], zero(doc[local]) + DECIDED),
        (cell[send], run[send], np.where(many, seed, 0)[send], doc[send], start[send], n[send], (local * KNOWN | many * SPREAD)[send]),
        (seed[mark], run[mark], zero(mark), doc[mark], start[mark], zero(mark), zero(mark) + MARK),
    ]
    return _columns(_RUNS_ARROW, *(np.concatenate([c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]) for columns in zip(*out)))


_SETTLED = "id bigint, start bigint, n int, seed bigint, known boolean"
_SETTLED_ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("seed", pa.int64()), ("known", pa.bool_())])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of cell, text and record: shared ones (without seed), a copy of each of them (with its seed, as
    known) and open ones (with their seed).

    Only rows of one record wait for the next batch: as soon as a second record is seen, all before it are decided.
    """
    def emit(rows: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
        i = np.flatnonzero(shared & (rows[:, 6] & DECIDED == 0))
        copies = i[np.append(True, (rows[i[1:], :2] != rows[i[:-1], :2]).any(axis=1))] if len(i) else i
        i = np.append(np.arange(len(rows)), copies)
        known = np.arange(len(i)) >= len(rows)
        seed = np.where(rows[i, 6] & SPREAD > 0, rows[i, 2], rows[i, 0])
        return pa.RecordBatch.from_arrays([pa.array(rows[i, 3]), pa.array(rows[i, 4]), pa.array(rows[i, 5].astype(np.int32)), pa.array(seed, mask=shared[i] & ~known), pa.array(known)], schema=_SETTLED_ARROW)

    held = np.empty((0, 7), np.int64)

    def judge(rows: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new_cell = np.append(True, rows[1:, 0] != rows[:-1, 0])
        new_run = new_cell | np.append(True, rows[1:, 1] != rows[:-1, 1])

        def shared(new: np.ndarray, signs: int) -> tuple[np.ndarray, np.ndarray]:
            first = np.flatnonzero(new)
            two = np.minimum.reduceat(rows[:, 3], first) != np.maximum.reduceat(rows[:, 3], first)
            return (two | (np.bitwise_or.reduceat(rows[:, 6], first) & signs > 0))[np.cumsum(new) - 1], first[-1:]

        by_run, last_run = shared(new_run, KNOWN)
        by_cell, last_cell = shared(new_cell, KNOWN | MARK | SPREAD)
        done = np.ones(len(rows), bool)
        if not end:
            if by_cell[-1]:
                done[last_run[0] :] = by_run[-1]
            else:
                done[last_cell[0] :] = False
        kept = rows[~done]
        if not end and by_cell[-1]:  # that the cell, perhaps the run, is shared is all to remember of what is done
            memory = rows[-1:].copy()
            memory[0, 6] = MEMORY | MARK | KNOWN * by_run[-1]
            kept = np.concatenate([memory, kept])
        out = done & (rows[:, 6] & (MEMORY | MARK) == 0) & by_cell
        return rows[out], by_run[out], kept

    for b in batches:
        rows = np.stack([c.to_numpy() for c in b.columns], axis=1).astype(np.int64)
        decided = rows[:, 6] & DECIDED > 0
        if decided.any():
            yield emit(rows[decided], np.ones(decided.sum(), bool))
        rows = np.concatenate([held, rows[~decided]])
        if len(rows):
            out, shared, held = judge(rows, False)
            yield emit(out, shared)
    if len(held):
        out, shared, _ = judge(held, True)
        yield emit(out, shared)


class Stretches:
    """Pieces of text (of one or more windows each) with their record, offset and whether they are known as shared."""

    def __init__(self, cell: list[int], doc: list[int], start: list[int], known: list[bool], text: list[str]):
        self.cell, self.doc, self.start, self.known, self.text = np.array(cell, np.int64), np.array(doc, np.int64), np.array(start, np.int64), np.array(known, bool), text

    def combine(self, length: int, spread: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Stretches]:
        """(record, start, windows) of the windows that are found to be shared, and what other tasks need to know.

        Of windows with one text one copy is left, marked as known; ``spread`` rows are left window by window, in cells
        by their text.
        """
        flat = Flat(self.text)
        at = flat.windows(length)
        row = flat.text[at]
        doc, start, known = self.doc[row], self.start[row] + at - flat.begin[row], self.known[row]
        hashes = flat.hashes(at, length)
        order, first, shared = _groups(hashes, doc)
        if len(at):
            shared |= np.logical_or.reduceat(known[order], first)
        of = np.empty(len(at), bool)
        of[order] = np.repeat(shared, np.diff(np.append(first, len(at))))
        found = np.flatnonzero(of & ~known)
        found = found[np.lexsort((start[found], doc[found]))]
        begin = _runs(doc[found], step=start[found])
        n = np.diff(np.append(begin, len(found)))
        send = ~of
        send[order[first[shared]]] = True
        single = np.zeros(len(at), bool) if spread is None else spread[row]
        left = np.flatnonzero(send)
        runs = np.flatnonzero(np.append(True, (row[left[1:]] != row[left[:-1]]) | (left[1:] != left[:-1] + 1) | (of[left[1:]] != of[left[:-1]]) | single[left[1:]])) if len(left) else left
        size = np.diff(np.append(runs, len(left))) + length - 1
        i = left[runs]
        inside = at[i] - flat.begin[row[i]]
        texts = [self.text[r][a : a + z] for r, a, z in zip(row[i].tolist(), inside.tolist(), size.tolist())]
        cell = np.where(single[i], hashes[i].view(np.int64), self.cell[row[i]])
        return doc[found[begin]], start[found[begin]], n, Stretches(cell, doc[i], start[i], of[i], texts)


_STRETCHES = "cell bigint, id bigint, start bigint, n int, known boolean, t string"
_STRETCHES_ARROW = pa.schema([("cell", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("known", pa.bool_()), ("t", pa.string())])
_FOUND = "id bigint, start bigint, n int"


def _found(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(n.astype(np.int32))], names=["id", "start", "n"])


def decide(batches: Iterator[pa.RecordBatch], length: int, points: int) -> Iterator[pa.RecordBatch]:
    """Shared windows of stretches in order of cell; a cell that outgrows ``points`` is reduced to its distinct windows."""
    cell, doc, start, known, text = [], [], [], [], []
    size, limit = 0, points
    for b in batches:
        said = pc.is_null(b.column("t"))
        if pc.any(said).as_py():
            ready = b.filter(said)
            yield pa.RecordBatch.from_arrays([ready.column(c) for c in ("id", "start", "n")], names=["id", "start", "n"])
            b = b.filter(pc.invert(said))
        for c, d, s, k, t in zip(*(b.column(x).to_pylist() for x in ("cell", "id", "start", "known", "t"))):
            if size >= limit:
                changed = c != cell[-1]
                *found, left = Stretches(cell, doc, start, known, text).combine(length)
                yield _found(*found)
                cell, doc, start, known, text = [], [], [], [], []
                if not changed:  # the open cell goes on
                    i = np.flatnonzero(left.cell == c).tolist()
                    cell, doc, start, known, text = left.cell[i].tolist(), left.doc[i].tolist(), left.start[i].tolist(), left.known[i].tolist(), [left.text[j] for j in i]
                size = sum(map(len, text))
                limit = max(points, 2 * size)
            for column, v in zip((cell, doc, start, known, text), (c, d, s, k, t)):
                column.append(v)
            size += len(t)
    if cell:
        yield _found(*Stretches(cell, doc, start, known, text).combine(length)[:3])


def unite(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of shared windows (record, start, windows) that come in order of record and start."""
    names = ["id", "span_start", "span_end"]
    held = np.empty((0, 3), np.int64)
    for b in batches:
        doc, start, n = (c.to_numpy().astype(np.int64) for c in b.columns)
        rows = np.concatenate([held, np.stack([doc, start, start + n + length - 1], axis=1)])
        if not len(rows):
            continue
        doc, start, end = rows.T
        # The furthest end so far in the same document: ends of later documents are lifted above all earlier ones.
        lift = np.cumsum(np.append(False, doc[1:] != doc[:-1])) * (end.max() + 1)
        furthest = np.maximum.accumulate(end + lift) - lift
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > furthest[:-1])))
        last = np.append(new[1:], len(doc)) - 1
        out = np.stack([doc[new], start[new], furthest[last]], axis=1)
        held = out[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out[:-1].T], names=names)
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.T], names=names)


def shared_spans(df: DataFrame, key: str, text: str, length: int = LENGTH, seed: int = SEED, points: int = CHUNK_POINTS) -> DataFrame:
    """(key, span_start, span_end): longest unbroken stretches of code points that lie in some sequence of ``length``
    code points which also stands, verbatim, in the text of another record. Offsets from 0, end exclusive.

    Defined cases: rows with null key or text and texts shorter than ``length`` give no rows. Rows that share a key
    are one record (what they share with one another does not count; their spans are united). Texts of any length are
    read whole, long ones in overlapping pieces of ``points`` code points. An empty table gives no rows; extra columns
    are never read. Equality of two stretches is by a 64-bit hash of them (runs: and one of their seed), compared among
    the holders of one seed only.
    """
    texts = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, base, parts in _pieces(batches, length - 1, points):
            rows = runs_of(ids, base, parts, length, seed)
            if rows is not None:
                yield rows

    runs = texts.mapInArrow(scan, _RUNS).repartition("cell").sortWithinPartitions("cell", "run", "id")
    settled = stage(runs.mapInArrow(settle, _SETTLED), "span-runs")
    of_seeds = settled.where("seed IS NOT NULL")
    open_seeds = of_seeds.groupBy("seed").agg((F.count(F.lit(1)) > OPEN_ROWS).alias("spread"), F.bool_and("known").alias("settled")).where("NOT settled")
    asked = of_seeds.join(open_seeds, "seed").groupBy("id").agg(F.collect_list(F.struct("start", "n", "seed", "spread", "known")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bool, bool, str]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            seed, doc, start, spread, known, text = zip(*held)
            doc, start, n, left = Stretches(seed, doc, start, known, text).combine(length, np.array(spread, bool))
            yield _columns(_STRETCHES_ARROW.remove(5), mix(doc), doc, start, n, np.zeros(len(doc), bool)).append_column("t", pa.nulls(len(doc), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(left.cell), pa.array(left.doc), pa.array(left.start), pa.nulls(len(left.text), pa.int32()), pa.array(left.known), pa.array(left.text, pa.string())], schema=_STRETCHES_ARROW)

        for b in batches:
            runs, ends = b.column("runs").flatten(), b.column("runs").offsets.to_numpy()
            ends = ends - ends[0]
            start, n, of, spread, known = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "seed", "spread", "known"))
            for i in range(b.num_rows):
                doc, text = b.column("id")[i].as_py(), b.column("t")[i].as_py()
                for j in range(ends[i], ends[i + 1]):
                    piece = text[start[j] : start[j] + n[j] + length - 1]
                    if len(piece) >= length:  # else of another text of this record
                        held.append((of[j], doc, start[j], spread[j], known[j], piece))
                        size += len(piece)
                    if size >= points:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    stretches = texts.join(asked, "id").select("id", "t", "runs").mapInArrow(cut, _STRETCHES)
    late = stretches.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: decide(batches, length, points), _FOUND)
    found = settled.where("seed IS NULL").select("id", "start", "n").unionAll(late)
    spans = found.repartition("id").sortWithinPartitions("id", "start").mapInArrow(lambda batches: unite(batches, length), "id bigint, span_start bigint, span_end bigint")
    return spans.withColumnRenamed("id", key)
