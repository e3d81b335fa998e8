"""Evaluation passages in a corpus, by latent semantic retrieval.

1. Corpus passages (blocks of consecutive words) become TF-IDF vectors over hashed terms; document frequencies come from
   all passages.
2. A distributed randomised SVD finds the latent space: every task adds up its share of Y = A'(A R) for a random R of a
   few columns more than the rank, the shares are summed in a tree of bounded fan-in, and the driver takes the leading
   right singular vectors of A from the sketch (R, Y), both of fixed size.
3. Windows of the items (every position) and of the documents (side by side) are projected and compared by cosine.
4. Candidates are checked by the longest common subsequence of the words around both windows; those left, word by word.

The windows make the retrieval lossless for verbatim leaks. A run of r words shared with an item holds, whatever its
position, one whole document window of m words if r >= 2 m - 1; that window and the item's window at the same place
have the same words and so the same latent vector: a cosine of 1. A threshold just below 1 therefore finds every run,
and the check keeps those that are long enough. Items are few (a stated query set); they are broadcast in blocks of
bounded size and the corpus is read once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..staging import stage
from .words import WordHashes, words

RUN = 13
TERMS = 1 << 15  # hashed term space
RANK, EXTRA = 32, 8  # dimensions of the latent space, further columns of the sketch
FAN_IN = 32  # vectors that one task adds up
PASSAGE = 32  # words of a TF-IDF passage
SIZES = (1, 2, 3, 5, 7)  # window sizes in words, for runs of at least 1, 3, 5, 9 and 13 words
COSINE = 0.9999
BATCH_CHARS = 2_000_000
BATCH_WORDS = 400_000
BLOCK_WINDOWS = 200_000  # item windows broadcast at once


def tokens(texts: DataFrame) -> DataFrame:
    """(id, words): 64-bit word hashes of every text (id, t), written once for the passes that follow."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in _cuts(size, BATCH_CHARS):
                flat, counts = hasher(batch.column(1).slice(a, b - a).to_pylist())
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "words"])

    return stage(texts.mapInArrow(scan, "id bigint, words array<bigint>"), "leak-words")


def _cuts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``."""
    part = np.cumsum(size) // most
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else []
    yield from zip(edges[:-1], edges[1:])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, word hashes one after another, words of each text) of at most about BATCH_WORDS words together."""
    for batch in batches:
        counts = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in _cuts(counts, BATCH_WORDS):
            part = batch.column(1).slice(a, b - a)
            yield batch.column(0).slice(a, b - a), part.flatten().to_numpy().view(np.uint64), counts[a:b]


def _blocks(counts: np.ndarray, size: int, whole: bool) -> np.ndarray:
    """First words of the side-by-side blocks of ``size`` words of each text; whole: without a shorter last one."""
    n = counts // size if whole else -(-counts // size)
    start = np.cumsum(counts) - counts
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(start, n) + within * size


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(7)).astype(np.int64) % TERMS


def _passages(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (passage, term) pairs with their frequency, as passage * TERMS + term and count."""
    starts = _blocks(counts, PASSAGE, False)
    mark = np.zeros(len(hashes), np.int64)
    mark[starts] = 1
    return np.unique((np.cumsum(mark) - 1) * TERMS + _terms(hashes), return_counts=True)


def _add_up(parts: DataFrame, tasks: int) -> np.ndarray:
    """Sum of equally long float64 vectors in rows (part int, share binary), in the order of part; of a fixed size.

    The vectors of ``tasks`` tasks are summed in rounds, each of FAN_IN vectors at most by one task.
    """
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float64) for b in pdf["share"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "lane": [pdf["lane"].iloc[0]], "share": [total.tobytes()]})

    rows = parts.withColumn("lane", F.spark_partition_id())
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        rows = rows.withColumn("lane", F.floor(F.col("lane") / FAN_IN).cast("int")).groupBy("part", "lane").applyInPandas(add, "part int, lane int, share binary")
    total: dict[int, np.ndarray] = {}
    for r in rows.select("part", "share").toLocalIterator():
        total[r["part"]] = total.get(r["part"], 0) + np.frombuffer(r["share"], np.float64)
    return np.concatenate([total[k] for k in sorted(total)]) if total else np.empty(0)


def _emit(vector: np.ndarray, parts: int) -> pa.RecordBatch:
    shares = [s.astype(np.float64).tobytes() for s in np.split(vector, parts)]
    return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(shares, pa.binary())], names=["part", "share"])


def latent_space(corpus: DataFrame) -> np.ndarray:
    """TERMS x RANK: row t is what one occurrence of hashed term t adds to a latent vector. ``corpus``: see tokens."""
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1)
        for _, flat, counts in _slices(batches):
            if len(flat):
                pairs, _ = _passages(flat, counts)
                total[:TERMS] += np.bincount(pairs % TERMS, minlength=TERMS)
                total[TERMS] += len(_blocks(counts, PASSAGE, False))
        yield _emit(total, 1)

    tasks = 1 + corpus.select(F.spark_partition_id().alias("p")).agg(F.coalesce(F.max("p"), F.lit(0))).first()[0]
    seen = _add_up(corpus.mapInArrow(frequencies, "part int, share binary"), tasks)
    idf = np.log1p(seen[TERMS] / (1 + seen[:TERMS])) if len(seen) else np.ones(TERMS)
    width = RANK + EXTRA
    start = np.linalg.qr(np.random.default_rng(20160104).standard_normal((TERMS, width)))[0].astype(np.float32)
    shared = corpus.sparkSession.sparkContext.broadcast((idf, start))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, start = shared.value
        total = np.zeros((width, TERMS))
        for _, flat, counts in _slices(batches):
            if not len(flat):
                continue
            pairs, tf = _passages(flat, counts)
            passage, term = pairs // TERMS, pairs % TERMS
            weight = (1 + np.log(tf)) * idf[term]
            first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
            norm = np.sqrt(np.add.reduceat(weight**2, first))
            weight = weight / np.repeat(norm, np.diff(np.append(first, len(passage))))
            projected = np.add.reduceat(start[term] * weight[:, None], first)
            for k in range(width):
                total[k] += np.bincount(term, projected[:, k][passage] * weight, minlength=TERMS)
        yield _emit(total.ravel(), width)

    summed = _add_up(corpus.mapInArrow(sketch, "part int, share binary"), tasks)
    basis = leading(start, summed.reshape(width, TERMS).T) if len(summed) else start[:, :RANK]
    return (basis * idf[:, None]).astype(np.float32)


def leading(start: np.ndarray, sketch: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors of A from R = ``start`` and A'A R = ``sketch``.

    A'A is replaced by its Nystroem approximation on the range of the sketch, whose eigenvectors follow from one small
    Cholesky factor and one thin SVD; a shift by rounding error keeps the factor defined.
    """
    start = start.astype(np.float64)
    shift = np.sqrt(start.shape[0]) * np.finfo(np.float32).eps * max(np.linalg.norm(sketch), 1e-30)
    moved = sketch + shift * start
    core = start.T @ moved
    factor = np.linalg.cholesky((core + core.T) / 2)
    left, _, _ = np.linalg.svd(np.linalg.solve(factor, moved.T).T, full_matrices=False)
    return left[:, :rank]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, by one integer of bits per word of ``a``."""
    masks: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a.tolist():
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


class Items:
    """The windows of a block of items, by window size."""

    def __init__(self, rows: list[tuple[int, list[str]]], run: int):
        hashes = [np.array([WordHashes.of(w) for w in ws], np.uint64) for _, ws in rows]
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.need = np.array([min(run, len(h)) for h in hashes], np.int64)
        count = np.array([len(h) for h in hashes], np.int64)
        self.begin, self.end = np.cumsum(count) - count, np.cumsum(count)
        self.flat = np.concatenate(hashes)
        size = np.array([max(m for m in SIZES if 2 * m - 1 <= n) for n in self.need])
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in sorted(set(size.tolist())):
            which = np.flatnonzero(size == m)
            n = count[which] - m + 1
            at = np.repeat(self.begin[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.windows[m] = (at, np.repeat(which, n))


def _project(space: np.ndarray, flat: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    vectors = space[_terms(flat)[at[:, None] + np.arange(m)]].sum(axis=1, dtype=np.float64)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def _near(docs: np.ndarray, items: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (document window, item window) with at least that cosine.

    Both sides are sorted by one coordinate; vectors that are near in all differ little in it, so that each block of
    document windows meets only a stretch of the item windows.
    """
    reach = np.sqrt(2 - 2 * cosine) + 1e-5
    axis = int(np.argmax(items.std(axis=0)))
    d_order, i_order = np.argsort(docs[:, axis]), np.argsort(items[:, axis])
    sorted_items = items[i_order]
    line = sorted_items[:, axis]
    left, right = [], []
    for a in range(0, len(docs), 512):
        block = d_order[a : a + 512]
        lo, hi = np.searchsorted(line, [docs[block[0], axis] - reach, docs[block[-1], axis] + reach])
        for b in range(lo, hi, 16384):
            x, y = np.nonzero(docs[block] @ sorted_items[b : min(b + 16384, hi)].T >= cosine)
            left.append(block[x])
            right.append(i_order[b + y])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _longest(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, other: np.ndarray, o_begin: np.ndarray, o_end: np.ndarray, o_at: np.ndarray, reach: int) -> np.ndarray:
    """Words that agree unbroken around (at, o_at), up to ``reach`` on either side."""
    out = np.zeros(len(at), np.int64)
    for step in (1, -1):
        alive = np.ones(len(at), bool)
        for k in range(0 if step == 1 else 1, reach + 1):
            p, q = at + step * k, o_at + step * k
            alive &= (p >= begin) & (p < end) & (q >= o_begin) & (q < o_end)
            i = np.flatnonzero(alive)
            alive[i] = flat[p[i]] == other[q[i]]
            out += alive
            if not alive.any():
                break
    return out


def find_leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str, run: int = RUN) -> DataFrame:
    """Distinct (doc_key, item_key) where a document contains ``run`` consecutive words of an item's passage.

    A passage of fewer words must be contained whole. Words are longest runs of letters and digits of the normalised
    text (see ``words``).

    Defined cases: documents or items with null key or text, and passages without words, give no rows; texts of any
    length are searched whole; rows that share a key count as one document; empty tables give no rows; only the named
    columns are read, so that others may clash. Items are a query set: they are read through the driver in blocks of
    BLOCK_WINDOWS words (about 60 MB of vectors and hashes), each of which is one broadcast and one pass over the corpus.
    """
    out = T.StructType([T.StructField(doc_key, T.LongType()), T.StructField(item_key, T.LongType())])
    texts = docs.select(F.col(doc_key).cast("bigint").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    spark, found, corpus, space, block, held = docs.sparkSession, None, None, None, [], 0

    def search(rows: list[tuple[int, list[str]]]) -> DataFrame:
        nonlocal corpus, space
        if corpus is None:
            corpus = tokens(texts)
            space = latent_space(corpus)
        shared = spark.sparkContext.broadcast((space, Items(rows, run)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            targets = {m: _project(space, items.flat, at, m) for m, (at, _) in items.windows.items()}
            for ids, flat, counts in _slices(batches):
                begin, end = np.cumsum(counts) - counts, np.cumsum(counts)
                hits = [np.empty((0, 2), np.int64)]
                for m, (i_at, which) in items.windows.items():
                    at = _blocks(counts, m, True)
                    if not len(at):
                        continue
                    d, i = _near(_project(space, flat, at, m), targets[m], COSINE)
                    at, i_at, item = at[d], i_at[i], which[i]
                    doc = np.searchsorted(end, at, "right")
                    # A run of the item's words is a common subsequence of what surrounds the two windows.
                    low, high = np.maximum(begin[doc], at - run), np.minimum(end[doc], at + m + run)
                    i_low, i_high = np.maximum(items.begin[item], i_at - run), np.minimum(items.end[item], i_at + m + run)
                    likely = np.array([common(items.flat[p:q], flat[x:y]) >= n for p, q, x, y, n in zip(i_low, i_high, low, high, items.need[item])], bool)
                    doc, item, at, i_at = doc[likely], item[likely], at[likely], i_at[likely]
                    n = _longest(flat, begin[doc], end[doc], at, items.flat, items.begin[item], items.end[item], i_at, run)
                    good = n >= items.need[item]
                    hits.append(np.stack([doc[good], item[good]], axis=1))
                pairs = np.unique(np.concatenate(hits), axis=0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs[:, 0])), pa.array(items.ids[pairs[:, 1]])], names=[doc_key, item_key])

        return corpus.mapInArrow(scan, out)

    for row in items.select(F.col(item_key).cast("bigint"), passage).where(F.col(item_key).isNotNull()).toLocalIterator():
        ws = words(row[1])
        if ws:
            block.append((row[0], ws))
            held += len(ws)
        if held >= BLOCK_WINDOWS:
            part = search(block)
            found = part if found is None else found.unionAll(part)
            block, held = [], 0
    if block:
        part = search(block)
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], out) if found is None else found.distinct()
