"""Fuzzy passages that two records share, by collinear chaining of seeds.

Seeds (k-mers chosen by content) are joined across records. All matches of one pair of records that rise in both are
chained with a linear gap cost. With such a cost the best chain that ends before a point is a prefix maximum, which a
Fenwick tree over the second record's positions answers in logarithmic time. A chain that scores enough is aligned: the
two stretches it spans are compared by the length of their longest common subsequence.

Every pair of records with a passage is reported for itself, so that the rows of a passage that many records hold grow
with the square of its holders. What is done for each pair is kept small: pairs are dealt to cells in which all of their
matches meet, pairs with too few matches for any chain are left at once, a pattern of matches that many pairs have is
chained once, stretches of the same text need no alignment, and of the others each two texts are aligned once.

Without ``exact`` only links are reported, with work in proportion to the holders. A unit is the shortest stretch of
consecutive seeds of a record whose chain with a verbatim copy scores enough. Holders of one unit are copies: each is
linked to the first one, which stands for all of them. What remains are seeds in no shared unit and those of first
holders. These are matched by pairs of seeds, in one order, less than ``REACH`` apart. Links can be lost: where records
hold a passage as copies of several first holders none of which has enough of it, where a seed of a chain stands alone,
and where all seeds of a passage are the same. The registered query does not use this form.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .spans import _BASE, _INVERSE, Flat, _pieces, _powers, mix, seeds

K, STRETCH = 16, 48
GAP_COST, LEAST_SCORE, LEAST_SHARE = 0.2, 60.0, 0.8
UNIT_STEPS = 7  # of 8 bits in one integer; a step of 33 positions, the longest between seeds, needs 5
REACH = 160  # positions: a step of less than 80 on the average of both sides costs less than a seed earns
BLOCK_ROWS = 20_000  # of one pair of seeds that meet in one cell
PAIRS = 500_000  # in one Arrow batch
GROUP_ROWS = 200_000  # seeds of a group of records
POINTS = 1_000_000  # matches at a time
FEWEST = int(-(-LEAST_SCORE // K))  # matches of a chain that scores enough
KEPT = 100_000  # patterns of matches whose chains are kept
NOBODY = np.iinfo(np.int64).min


class PrefixMaximum:
    """Fenwick tree of (value, index) with prefix maxima."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: float, index: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, index)
            at += at & -at

    def before(self, at: int) -> tuple[float, int]:
        """The largest value at a position below ``at``, the earliest put of several."""
        out = (float("-inf"), -1)
        while at:
            if self.best[at][0] > out[0]:
                out = self.best[at]
            at -= at & -at
        return out


def best_chains(x: np.ndarray, y: np.ndarray, k: int, gap_cost: float, least: float) -> list[list[int]]:
    """Chains of matches (x[i], y[i]), sorted by x then y, that rise in both; each match in one chain, best ones first.

    The score of a chain is k a match, less ``gap_cost`` for every position that its steps advance beyond what seeds
    cover, on either side.
    """
    ranks = np.unique(y, return_inverse=True)[1]
    tree, score, back = PrefixMaximum(int(ranks.max()) + 1), np.zeros(len(x)), np.full(len(x), -1)
    at = 0
    while at < len(x):
        same = at
        while same < len(x) and x[same] == x[at]:  # matches at one x don't follow one another
            value, j = tree.before(int(ranks[same]))
            reach = 0.5 * gap_cost * (x[same] + y[same])
            score[same] = k
            if j >= 0 and value - reach + k > k:
                score[same], back[same] = value - reach + k, j
            same += 1
        for i in range(at, same):
            tree.put(int(ranks[i]), score[i] + 0.5 * gap_cost * (x[i] + y[i]), i)
        at = same
    out, used = [], np.zeros(len(x), bool)
    for end in np.argsort(-score, kind="stable"):
        if score[end] < least:
            break
        chain, i = [], end
        while i >= 0 and not used[i]:
            chain.append(int(i))
            used[i] = True
            i = back[i]
        if chain and score[end] - (score[i] if i >= 0 else 0) >= least:
            out.append(chain[::-1])
    return out


def straight(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """First and last match of every stretch that scores enough on one diagonal, with steps of less than STRETCH."""
    order = np.lexsort((x, y - x))
    step, moved = np.diff(x[order]), np.diff((y - x)[order]) != 0
    first = np.flatnonzero(np.append(True, moved | (step >= STRETCH)))
    last = np.append(first[1:], len(x)) - 1
    score = K * (last - first + 1) - GAP_COST * (x[order[last]] - x[order[first]])
    return [(int(order[a]), int(order[b])) for a, b in zip(first[score >= LEAST_SCORE], last[score >= LEAST_SCORE])]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one big-integer row of bits per character of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def units(flat: Flat, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each seed the hash of the unit that begins with it (0: none) and its steps to the unit's other seeds, 8 bits each."""
    n, row, piece = len(at), np.arange(len(at)), flat.text[at]
    hashes, steps, score, alive = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.full(n, float(K)), np.ones(n, bool)
    for s in range(1, UNIT_STEPS + 1):
        alive &= row + s < n
        i = np.flatnonzero(alive)
        step = at[i + s] - at[i + s - 1]
        good = (piece[i + s] == piece[i]) & (step < 256)
        alive[i[~good]] = False
        i, step = i[good], step[good]
        steps[i] |= step << (8 * (s - 1))
        score[i] += K - GAP_COST * step
        i = i[score[i] >= LEAST_SCORE]
        size = at[i + s] + K - at[i]
        hashes[i] = mix(mix((flat.sums[at[i] + size] - flat.sums[at[i]]) * flat.inverse[at[i]]) ^ mix(steps[i]))
        alive[i] = False
    steps[hashes == 0] = 0
    return hashes, steps


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Rows of integer columns sorted by the first ``keys``, in arrays that hold whole groups only."""
    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in b.columns], axis=1)
        joined = rows if not held else np.concatenate([held[-1][-1:], rows])
        cut = np.flatnonzero((joined[1:, :keys] != joined[:-1, :keys]).any(axis=1)) + 1 - (len(joined) - len(rows))
        if not len(cut):
            held.append(rows)
            continue
        yield np.concatenate([*held, rows[: cut[-1]]])
        held = [rows[cut[-1] :]]
    if held:
        yield np.concatenate(held)


def spread(place: np.ndarray, steps: np.ndarray, i: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``i``, reach, rows that the reach leads to) for every seed of the units that begin at ``i``; ``place`` is sorted."""
    reach = np.zeros(len(i), np.int64)
    for s in range(UNIT_STEPS + 1):
        to = np.minimum(np.searchsorted(place, place[i] + reach), len(place) - 1)
        there = place[to] == place[i] + reach
        yield i[there], reach[there], to[there]
        step = (steps[i] >> (8 * s)) & 255 if s < UNIT_STEPS else np.zeros(len(i), np.int64)
        i, reach = i[step > 0], (reach + step)[step > 0]


def close_pairs(line: np.ndarray, rows: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of ``rows``, j after i by less than REACH on the sorted ``line``, of two different seeds."""
    left, right = [], []
    at = line[rows]
    for s in range(1, len(rows)):
        i = np.flatnonzero(at[s:] - at[:-s] < REACH)
        if not len(i):
            break
        left.append(rows[i])
        right.append(rows[i + s])
    i, j = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (left, right))
    other = seed[i] != seed[j]
    return i[other], j[other]


def pairs_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, about PAIRS at a time; rows are in order of group."""
    n = len(group)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    stop = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    after = np.arange(1, n + 1)
    done = np.append(0, np.cumsum(stop - after))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, "right")) - 1)
        size = (stop - after)[a:b]
        left = np.repeat(np.arange(a, b), size)
        if len(left):
            yield left, np.repeat(after[a:b] - (done[a:b] - done[a]), size) + np.arange(len(left))
        a = b


def shared_passages(df: DataFrame, key: str, text: str, exact: bool = True) -> DataFrame:
    """(key, partner, start, end, partner_start, partner_end, share): passages alike in two records, key above partner.

    ``share`` is the longest common subsequence over the longer of the two stretches, at least LEAST_SHARE. Null keys
    and texts give nothing; rows that share a key are one record; an empty table gives no rows. Without ``exact`` copies
    are only linked to their first holder: fewer rows, and not every pair is connected by them.
    """
    texts = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, base, parts in _pieces(batches, STRETCH - 1):
            flat = Flat(parts)
            at, hashes = seeds(flat, flat.windows(STRETCH), STRETCH, K)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
            at, hashes = at[first], hashes[first]
            piece = flat.text[at]
            unit, steps = (np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)) if exact else units(flat, at)
            whole = mix(mix((flat.sums[flat.end] - flat.sums[flat.begin]) * flat.inverse[np.minimum(flat.begin, flat.n - 1)]) ^ mix(base))
            before = (flat.sums[at] - flat.sums[flat.begin[piece]]) * flat.inverse[flat.begin[piece]] * powers(_BASE, base)[piece]
            columns = [ids[piece], whole[piece], at - flat.begin[piece] + base[piece], hashes, unit, steps, before + whole[piece]]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["id", "piece", "pos", "seed", "unit", "steps", "before"])

    found = stage(texts.mapInArrow(scan, "id bigint, piece bigint, pos bigint, seed bigint, unit bigint, steps bigint, before bigint"), "passage-seeds")
    out = _all_pairs(found.select("id", "pos", "seed", "before"), texts) if exact else _linked(found.drop("before"), texts)
    return out.withColumnsRenamed({"id": key, "a0": "start", "a1": "end", "b0": "partner_start", "b1": "partner_end"})


def powers(base: int, exponent: np.ndarray) -> np.ndarray:
    """base to each exponent, modulo 2**64."""
    top = int(exponent.max(initial=0))
    out = _powers(base, 1 << 16)[exponent & 0xFFFF]
    return out * _powers(pow(base, 1 << 16, 1 << 64), (top >> 16) + 1)[exponent >> 16] if top >> 16 else out


class Side:
    """Seeds of a group of records in order of record and position; ``before`` sums up the text before each."""

    def __init__(self, rows: np.ndarray):
        rows = rows[np.lexsort(rows[:, [3, 0, 2, 1]].T)]
        rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))] if len(rows) else rows
        self.seed, self.id, self.pos, self.before = np.ascontiguousarray(rows.T)
        new = np.flatnonzero(np.append(True, self.id[1:] != self.id[:-1])) if len(rows) else np.empty(0, np.int64)
        size = np.diff(np.append(new, len(rows)))
        self.record, self.rank = np.repeat(np.arange(len(new)), size), np.arange(len(rows)) - np.repeat(new, size)
        self.first, self.longest = new, int(size.max(initial=1))


def meetings(a: Side, b: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of ``a``, j of ``b``) of one seed, id of j below that of i, about POINTS at a time; whole pairs of records,
    one after another, by i then j. Pairs with too few for a chain are left away."""
    if not len(a.id) or not len(b.id):
        return
    order = np.argsort(b.seed, kind="stable")
    known, of_b = np.unique(b.seed, return_inverse=True)
    place = of_b[order] * np.int64(len(order) + 1) + order
    of_a = np.minimum(np.searchsorted(known, a.seed), len(known) - 1)
    lower = np.searchsorted(b.id, a.id)
    low = np.searchsorted(place, of_a * np.int64(len(order) + 1))
    count = np.searchsorted(place, of_a * np.int64(len(order) + 1) + lower) - low
    count[known[of_a] != a.seed] = 0
    done = np.append(0, np.cumsum(count))
    stops = np.append(a.first[1:], len(a.id))
    shift_i, shift_j, shift_b = (int(n).bit_length() for n in (a.longest, b.longest, len(b.first)))
    begin = 0
    while begin < len(stops):
        start = a.first[begin]
        until = max(begin + 1, int(np.searchsorted(done[stops], done[start] + POINTS, "right")))
        size = count[start : stops[until - 1]]
        i = np.repeat(np.arange(start, stops[until - 1]), size)
        if len(i):
            j = order[np.repeat(low[start : stops[until - 1]] - (done[start : stops[until - 1]] - done[start]), size) + np.arange(len(i))]
            if (until - begin).bit_length() + shift_b + shift_i + shift_j < 64:
                # One integer of record, other record and the two ranks, as sorting integers is much faster than sorting rows.
                point = (((a.record[i] - begin) << shift_b | b.record[j]) << shift_i | a.rank[i]) << shift_j | b.rank[j]
                point.sort()
                pair = point >> (shift_i + shift_j)
                many = _at_least(pair, FEWEST)
                point, pair = point[many], pair[many]
                i = a.first[(pair >> shift_b) + begin] + ((point >> shift_j) & ((1 << shift_i) - 1))
                j = b.first[pair & ((1 << shift_b) - 1)] + (point & ((1 << shift_j) - 1))
            else:
                sort = np.lexsort((j, i, b.record[j], a.record[i]))
                i, j = i[sort], j[sort]
                many = _at_least(a.record[i] * np.int64(len(b.first)) + b.record[j], FEWEST)
                i, j = i[many], j[many]
            if len(i):
                yield i, j
        begin = until


def _at_least(group: np.ndarray, n: int) -> np.ndarray:
    """Whether each row is in a group of ``n`` rows or more; rows are in order of group."""
    size = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)))
    return np.repeat(size >= n, size)


def ends(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first match, last match, part, inside) of the chains (part 0) and other straight stretches (part 1), inside: of a chain."""
    chained = [(c[0], c[-1]) for c in best_chains(x, y, K, GAP_COST, LEAST_SCORE)]
    out = [(c, d, 0, 0) for c, d in chained]
    for c, d in straight(x, y):
        if (c, d) not in chained:
            out.append((c, d, 1, int(any(x[p] <= x[c] and x[d] <= x[q] and y[p] <= y[c] and y[d] <= y[q] for p, q in chained))))
    return out


class Chains:
    """Chains of pairs of records. They do not depend on where a pair's matches begin; those of a pattern are kept."""

    def __init__(self):
        self.known: dict[int, list[tuple[int, int, int, int]]] = {}

    def of(self, a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        """Columns of _CHAINED of whole pairs. ``left`` and ``right`` tell the texts of the stretches; 0: settled as verbatim."""
        pair = a.record[i] * np.int64(len(b.first)) + b.record[j]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        size = np.diff(np.append(first, len(pair)))
        x, y = a.pos[i], b.pos[j]
        moved_x, moved_y = x - np.repeat(x[first], size), y - np.repeat(y[first], size)
        pattern = mix(np.add.reduceat(mix(mix(moved_x) + moved_y.view(np.uint64)), first)) ^ mix(size)
        each, example, which = np.unique(pattern, return_index=True, return_inverse=True)
        found = []
        for h, e in zip(each.tolist(), example.tolist()):
            own = self.known.get(h)
            if own is None:
                own = ends(x[first[e] : first[e] + size[e]] - x[first[e]], y[first[e] : first[e] + size[e]] - y[first[e] : first[e] + size[e]].min())
                if len(self.known) < KEPT:
                    self.known[h] = own
            found.append(own)
        n = np.array([len(f) for f in found])
        table = np.array([e for f in found for e in f], np.int64).reshape(-1, 4)
        count = n[which]
        of = np.repeat(np.arange(len(first)), count)
        row = table[np.repeat((np.cumsum(n) - n)[which] - (np.cumsum(count) - count), count) + np.arange(len(of))]
        c, d, part, inside = first[of] + row[:, 0], first[of] + row[:, 1], row[:, 2], row[:, 3] > 0
        left, right = (((s.before[r[d]] - s.before[r[c]]).view(np.uint64) * powers(_INVERSE, s.pos[r[c]])).view(np.int64) for s, r in ((a, i), (b, j)))
        verbatim = (left == right) & (x[d] - x[c] == y[d] - y[c])
        # A pair is open if a chain, or a stretch in none, must be compared by its letters.
        open_ = np.bincount(of[~verbatim & ~inside], minlength=len(first))[of] > 0
        keep = open_ | ~inside
        columns = [a.id[i[c]], b.id[j[c]], x[c], x[d] + K, y[c], y[d] + K, part, left * open_, right * open_, open_.astype(np.int64)]
        return [v[keep] for v in columns]


def told(texts: list[str], h: int) -> list[str]:
    """Those of ``texts`` that ``left`` or ``right`` tells: a record of several rows has several at one place."""
    if len(texts) == 1:
        return texts
    return [t for t in texts if Flat([t[:-K]]).sums[-1:].view(np.int64)[0] == h] or texts


_CHAINED = ["id", "partner", "a0", "a1", "b0", "b1", "part", "left", "right", "open"]


def _all_pairs(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Passages of all pairs of records.

    Records are dealt to groups. Any two records meet in one cell, that of their two groups, with all of their common
    seeds; a seed goes only to cells in which two records hold it. The work is that of the pairs of records that have
    seeds in common, and the rows are those of the pairs that have a passage in common.
    """
    spark = found.sparkSession
    common = found.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("seed")
    shared = stage(found.join(common, "seed"), "passage-shared")
    groups = max(1, -(-shared.count() // GROUP_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 12))
    dealt = shared.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    held = dealt.groupBy("seed", "g").agg((F.min("id") < F.max("id")).alias("many"))
    held = held.groupBy("seed").agg(F.collect_list(F.struct("g", "many")).alias("held"))
    others = F.expr("transform(filter(held, h -> h.g <> g OR h.many), h -> h.g)")
    cells = dealt.join(held, "seed").select("seed", "id", "pos", "before", "g", F.explode(others).alias("h"))
    cell = F.least("g", "h").cast("bigint") * groups + F.greatest("g", "h")
    cells = cells.select(cell.alias("cell"), (F.col("g") > F.col("h")).cast("bigint").alias("side"), "seed", "id", "pos", "before")
    tasks = min(groups * (groups + 1) // 2, 2000)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = Chains()
        for rows in _whole_groups(batches, 1):
            for cell in np.split(rows, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1):
                a, b = (Side(cell[cell[:, 1] == s, 2:]) for s in (0, 1))
                same = cell[0, 0] // groups == cell[0, 0] % groups
                for one, other in [(a, a)] if same else [(a, b), (b, a)]:
                    for i, j in meetings(one, other):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in chains.of(one, other, i, j)], names=_CHAINED)

    met = cells.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(meet, ", ".join(f"{c} bigint" for c in _CHAINED))
    chained = stage(met, "passages-chained")
    places = ["id", "partner", "a0", "a1", "b0", "b1"]
    settled = chained.where("open = 0").select(*places, F.lit(1.0).alias("share"))

    # Stretches of one text are compared once.
    opened = chained.where("open = 1").withColumn("m", F.expr("a1 - a0")).withColumn("n", F.expr("b1 - b0"))
    pairs = opened.where("left <> right OR m <> n").select("left", "m", "right", "n").distinct()
    stretch = opened.select(F.col("left").alias("h"), F.col("m").alias("size"), "id", F.col("a0").alias("at")).unionAll(opened.select("right", "n", "partner", "b0"))
    stretch = stretch.groupBy("h", "size").agg(F.min(F.struct("id", "at")).alias("one")).select("h", "size", "one.id", "one.at")
    stretch = stretch.join(texts, "id").groupBy("h", "size").agg(F.collect_set(F.substring("t", F.col("at").cast("int") + 1, F.col("size").cast("int"))).alias("text"))
    named = lambda h, size, text: stretch.withColumnsRenamed({"h": h, "size": size, "text": text})
    pairs = pairs.join(named("left", "m", "left_text"), ["left", "m"]).join(named("right", "n", "right_text"), ["right", "n"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = (zip(*(b.column(c).to_pylist() for c in names)) for names in (("left_text", "left"), ("right_text", "right")))
            both = [(told(*one), told(*other)) for one, other in zip(*sides)]
            share = pa.array([max(1.0 if x == y else common_subsequence(x, y) / max(len(x), len(y), 1) for x in one for y in other) for one, other in both], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("left", "m", "right", "n")] + [share], names=["left", "m", "right", "n", "share"])

    shares = pairs.mapInArrow(align, "left bigint, m bigint, right bigint, n bigint, share double").where(F.col("share") >= LEAST_SHARE)
    same = (F.col("left") == F.col("right")) & (F.col("m") == F.col("n"))
    alike = opened.where(same).withColumn("share", F.lit(1.0)).select(*places, "part", "share")
    alike = stage(alike.unionAll(opened.where(~same).join(shares, ["left", "m", "right", "n"]).select(*places, "part", "share")), "passages-aligned")
    return settled.unionAll(_with_stretches(alike))


def _with_stretches(aligned: DataFrame) -> DataFrame:
    """Chains and the straight stretches that lie in none: a chain may run on from a good stretch through too little."""
    inside = (F.col("p.id") == F.col("c.id")) & (F.col("p.partner") == F.col("c.partner")) & F.expr("p.a0 >= c.a0 AND p.a1 <= c.a1 AND p.b0 >= c.b0 AND p.b1 <= c.b1")
    whole = aligned.where("part = 0")
    return whole.unionAll(aligned.where("part = 1").alias("p").join(whole.alias("c"), inside, "left_anti")).drop("part")


def _linked(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Passages of records with the first holder of each unit and, for seeds in none, with one another."""
    n = F.count(F.lit(1)).cast("bigint").alias("n")
    common = found.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), n).where("lo < hi").select("seed", "n")
    held = found.where("unit <> 0").groupBy("unit").agg(F.min(F.struct("id", "pos")).alias("first"), F.max("id").alias("hi")).where("first.id < hi")
    known = F.coalesce(F.col("first.id"), F.lit(NOBODY)).alias("first_id"), F.coalesce(F.col("first.pos"), F.lit(0)).cast("bigint").alias("first_pos")
    shared = stage(found.join(common, "seed").join(held, "unit", "left").select("id", "piece", "pos", "seed", "steps", *known, "n"), "passage-shared")

    def line(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all pieces one after another, and the rows at which shared units begin."""
        _, _, pos, _, _, first_id, _, _ = rows.T
        new = np.append(False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
        return np.cumsum(new) * (int(pos.max()) + 4096) + pos, np.flatnonzero(first_id != NOBODY)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Matches of every holder of a shared unit with the first one."""
        for rows in _whole_groups(batches, 2):
            place, i = line(rows)
            doc, _, pos, _, steps, first_id, first_pos, _ = rows.T
            i = i[first_id[i] < doc[i]]
            out = [np.stack([doc[a], first_id[a], pos[a] + reach, first_pos[a] + reach], axis=1) for a, reach, _ in spread(place, steps, i)]
            out = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.T], names=["id", "partner", "pos", "at"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Close pairs of seeds that stand in no shared unit or in one that this record holds first."""
        for rows in _whole_groups(batches, 2):
            place, i = line(rows)
            doc, _, pos, seed, steps, first_id, first_pos, n = rows.T
            covered, own = np.zeros((2, len(rows)), bool)
            for a, _, to in spread(place, steps, i):
                covered[to] = True
                own[to[(first_id[a] == doc[a]) & (first_pos[a] == pos[a])]] = True
            a, b = close_pairs(place, np.flatnonzero(~covered | own), seed)
            columns = [mix(mix(seed[a]) + seed[b].view(np.uint64)).view(np.int64), np.minimum(n[a], n[b]), doc[a], pos[a], pos[b]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "least", "id", "pos", "next"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 2):
            _, _, block, doc, pos, after = rows.T
            group = np.cumsum(np.append(False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            for a, b in pairs_within(group):
                good = (doc[a] != doc[b]) & ((block[a] != block[b]) | (block[a] < 0))
                a, b = a[good], b[good]
                a, b = np.where(doc[a] > doc[b], a, b), np.where(doc[a] > doc[b], b, a)
                a, b, x, y = np.tile(doc[a], 2), np.tile(doc[b], 2), np.append(pos[a], after[a]), np.append(pos[b], after[b])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, x, y)], names=["id", "partner", "pos", "at"])

    matched, paired = "id bigint, partner bigint, pos bigint, at bigint", "key bigint, least bigint, id bigint, pos bigint, next bigint"
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shared.repartition(tasks, "id").sortWithinPartitions("id", "piece", "pos")
    pairs = ordered.mapInArrow(keys, paired)
    # Only two seeds that are both frequent can be frequent together; such pairs meet block by block.
    frequent = shared.where(F.col("n") > BLOCK_ROWS).repartition(tasks, "id").sortWithinPartitions("id", "piece", "pos").mapInArrow(keys, paired)
    frequent = frequent.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = pairs.join(frequent, "key", "left").withColumn("block", block).withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    cell = F.coalesce(F.least("block", "other").cast("bigint") * F.col("blocks") + F.greatest("block", "other"), F.lit(0).cast("bigint"))
    # In a cell of two blocks only rows of different blocks meet; elsewhere (-1) all do.
    cells = cells.select("key", cell.alias("cell"), F.when(F.col("block") != F.col("other"), F.col("block")).otherwise(-1).cast("bigint").alias("side"), "id", "pos", "next")
    met = cells.repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(meet, matched)
    matches = ordered.mapInArrow(copies, matched).unionAll(met)

    names = ["id", "partner", "a0", "a1", "b0", "b1", "part"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains of each pair of records; rows come sorted by pair and position, and a pair may go on in the next batch."""
        known: dict[bytes, list[tuple[int, int]]] = {}
        for rows in _whole_groups(batches, 2):
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
            first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            last = np.append(first[1:], len(rows))
            enough = np.flatnonzero((last - first) * K >= LEAST_SCORE)
            yield passages([rows[a:b] for a, b in zip(first[enough], last[enough])], known)

    def passages(pairs: list[np.ndarray], known: dict[bytes, list[tuple[int, int]]]) -> pa.RecordBatch:
        """Chains do not depend on where a pair's matches begin; those of short patterns are kept."""
        out = []
        for rows in pairs:
            x, y = rows[:, 2], rows[:, 3]
            moved = np.stack([x - x[0], y - y.min()])
            pattern = moved.tobytes()
            ends = known.get(pattern)
            if ends is None:
                ends = [(c[0], c[-1], 0) for c in best_chains(*moved, K, GAP_COST, LEAST_SCORE)]
                ends += [(c, d, 1) for c, d in straight(*moved) if (c, d, 0) not in ends]
                if len(x) <= 64 and len(known) < 50_000:
                    known[pattern] = ends
            out += [(rows[0, 0], rows[0, 1], x[c], x[d] + K, y[c], y[d] + K, part) for c, d, part in ends]
        table = np.array(out, np.int64).reshape(-1, 7)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in table.T], names=names)

    chained = matches.repartition(tasks, "id", "partner").sortWithinPartitions("id", "partner", "pos", "at").mapInArrow(chain, "id bigint, partner bigint, a0 bigint, a1 bigint, b0 bigint, b1 bigint, part bigint")
    cut = lambda text, a, b: F.substring(text, F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int"))
    sides = chained.join(texts, "id").withColumn("left_text", cut(F.col("t"), "a0", "a1")).drop("t")
    sides = sides.join(texts.withColumnRenamed("id", "partner"), "partner").withColumn("right_text", cut(F.col("t"), "b0", "b1")).drop("t")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = lru_cache(50_000)(lambda x, y: common_subsequence(x, y) / max(len(x), len(y), 1))
        for b in batches:
            pairs = zip(b.column("left_text").to_pylist(), b.column("right_text").to_pylist())
            share = np.array([1.0 if x == y else measure(x, y) for x, y in pairs])
            good = pa.array(np.flatnonzero(share >= LEAST_SHARE))
            yield pa.RecordBatch.from_arrays([b.column(c).take(good) for c in names] + [pa.array(share).take(good)], names=[*names, "share"])

    aligned = stage(sides.repartition(tasks, "id", "partner").mapInArrow(align, "id bigint, partner bigint, a0 bigint, a1 bigint, b0 bigint, b1 bigint, part bigint, share double").distinct(), "passages-aligned")
    return _with_stretches(aligned).distinct()
