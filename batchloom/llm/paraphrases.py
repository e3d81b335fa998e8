"""Reworded evaluation passages: the latent search of ``leaks`` at a lower cosine, then subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .leaks import BLOCK_WINDOWS, PASSAGE, _near, _slices, _terms, common, latent_space, tokens
from .words import WordHashes, words

STRIDE = 8
COSINE = 0.8
SHORT_COSINE = 0.7  # at most, of windows of less than PASSAGE words, where each word weighs more
SHARE = 0.7
BITS = 512  # of a window's word signature


def windows(counts: np.ndarray, size: int = PASSAGE, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, text) of windows of ``size`` words every ``stride`` words; a shorter text is one window."""
    n = np.where(counts > 0, 1 + -(-np.maximum(counts - size, 0) // stride), 0)
    begin = np.repeat(np.cumsum(counts) - counts, n)
    text = np.repeat(np.arange(len(counts)), n)
    first = begin + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
    last = np.cumsum(counts)[text]
    first = np.minimum(first, np.maximum(begin, last - size))
    return first, np.minimum(first + size, last), text


def stride(size: int) -> int:
    """Steps of the document windows that meet item windows of ``size`` words."""
    return STRIDE if size >= PASSAGE else max(1, size // 8)


def totals(space: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Sums of the latent vectors of all words before each position."""
    upto = np.zeros((len(flat) + 1, space.shape[1]))
    np.cumsum(space[_terms(flat)], axis=0, out=upto[1:])
    return upto


def project(upto: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the windows; zero where nothing is known of any word."""
    v = (upto[end] - upto[first]).astype(np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v *= np.where(norm > 1e-9, 1 / np.maximum(norm, 1e-9), 0).astype(np.float32)[:, None]
    return v


def signatures(flat: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A bit for every word of each window, as rows of 64-bit integers."""
    bit = ((flat >> np.uint64(23)) % np.uint64(BITS)).astype(np.int64)
    out = np.zeros((len(first), BITS // 64), np.uint64)
    for k in range(int((end - first).max(initial=0))):
        i = np.flatnonzero(first + k < end)
        b = bit[first[i] + k]
        out[i, b >> 6] |= np.uint64(1) << (b & 63).astype(np.uint64)
    return out


def find_paraphrases(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str, answer: str, cosine: float = COSINE, share: float = SHARE) -> DataFrame:
    """(doc_key, item_key, cosine, share, has_answer): documents that hold a passage, perhaps reworded.

    A window of the document is a candidate if its latent vector has at least ``cosine`` with that of a window of the
    passage (or of all of it, if short) of the same number of words; SHORT_COSINE holds for
    passages of less than PASSAGE words. It counts if the longest common subsequence of the passage's window and the
    document's, widened by half a window on either side, covers at least ``share`` of the former. A subsequence that
    long leaves at most the other words' bits of the passage's signature out of the document's, which rules out most
    candidates at once and loses none. ``has_answer`` tells
    whether all words of the item's answer stand, in order and unbroken, in the document. The best window of each pair
    is reported. Null keys, texts and passages give no rows; items are searched in blocks of bounded size.
    """
    out = T.StructType([T.StructField(doc_key, T.LongType()), T.StructField(item_key, T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("share", T.DoubleType()), T.StructField("has_answer", T.BooleanType())])
    texts = docs.select(F.col(doc_key).cast("bigint").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    spark, found, corpus, space, block, held = docs.sparkSession, [], None, None, [], 0
    code = lambda ws: np.array([WordHashes.of(w) for w in ws], np.uint64)

    def search(rows: list[tuple[int, list[str], list[str]]]) -> DataFrame:
        nonlocal corpus, space
        if corpus is None:
            corpus = tokens(texts)
            space = latent_space(corpus)
        keys, passages, answers = np.array([r[0] for r in rows], np.int64), [code(r[1]) for r in rows], [code(r[2]) for r in rows]
        shared = spark.sparkContext.broadcast((space, keys, passages, answers))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, keys, passages, answers = shared.value
            i_flat = np.concatenate(passages)
            i_first, i_end, which = windows(np.array([len(p) for p in passages]))
            targets, sizes = project(totals(space, i_flat), i_first, i_end), i_end - i_first
            i_signs, spare = signatures(i_flat, i_first, i_end), np.floor((1 - share) * (i_end - i_first) + 1e-9)
            for ids, flat, counts in _slices(batches):
                begin, stop = np.cumsum(counts) - counts, np.cumsum(counts)
                upto = totals(space, flat)
                best: dict[tuple[int, int], tuple[float, float]] = {}
                for size in np.unique(sizes).tolist():
                    first, end, doc = windows(counts, size, stride(size))
                    if not len(first):
                        continue
                    of_size = np.flatnonzero(sizes == size)
                    vectors = project(upto, first, end)
                    near_d, near_i = _near(vectors, targets[of_size], cosine if size >= PASSAGE else min(cosine, SHORT_COSINE))
                    near_i = of_size[near_i]
                    met, row = np.unique(near_d, return_inverse=True)
                    low, high = np.maximum(begin[doc[met]], first[met] - PASSAGE // 2), np.minimum(stop[doc[met]], end[met] + PASSAGE // 2)
                    signs = signatures(flat, low, high)
                    good = np.ones(len(row), bool)
                    for a in range(0, len(row), 100_000):
                        d, i = row[a : a + 100_000], near_i[a : a + 100_000]
                        good[a : a + 100_000] = np.bitwise_count(i_signs[i] & ~signs[d]).sum(axis=1) <= spare[i]
                    for d, i in zip(row[good], near_i[good]):
                        wanted = i_flat[i_first[i] : i_end[i]]
                        part = common(wanted, flat[low[d] : high[d]]) / len(wanted)
                        if part >= share:
                            pair = int(doc[met[d]]), int(which[i])
                            best[pair] = max(best.get(pair, (0.0, 0.0)), (part, float(vectors[met[d]] @ targets[i])))
                rows = [(p, v, _holds(flat[begin[p[0]] : stop[p[0]]], answers[p[1]])) for p, v in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([p[0] for p, _, _ in rows], pa.int64())), pa.array([keys[p[1]] for p, _, _ in rows], pa.int64()), pa.array([v[1] for _, v, _ in rows], pa.float64()), pa.array([v[0] for _, v, _ in rows], pa.float64()), pa.array([h for _, _, h in rows], pa.bool_())], names=out.names)

        return corpus.mapInArrow(scan, out)

    for row in items.select(F.col(item_key).cast("bigint"), passage, answer).where(F.col(item_key).isNotNull()).toLocalIterator():
        ws = words(row[1])
        if ws:
            block.append((row[0], ws, words(row[2])))
            held += len(ws)
        if held >= BLOCK_WINDOWS:
            found.append(search(block))
            block, held = [], 0
    if block:
        found.append(search(block))
    if not found:
        return spark.createDataFrame([], out)
    result = found[0]
    for part in found[1:]:
        result = result.unionAll(part)
    return result.groupBy(doc_key, item_key).agg(F.max("cosine").alias("cosine"), F.max("share").alias("share"), F.bool_or("has_answer").alias("has_answer"))


def _holds(text: np.ndarray, answer: np.ndarray) -> bool:
    if not len(answer) or len(answer) > len(text):
        return False
    at = np.flatnonzero(text[: len(text) - len(answer) + 1] == answer[0])
    return bool(len(at)) and bool((text[at[:, None] + np.arange(len(answer))] == answer).all(axis=1).any())
