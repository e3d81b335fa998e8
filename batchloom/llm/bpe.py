"""Byte-level BPE encoding of whole corpora in batched numpy merge rounds.

A batch of texts is split into words by the vocabulary's pattern, and every distinct word is encoded once. The symbols
of all these words lie in one flat array. A round finds the rank of every adjacent pair by binary search over the
sorted pair keys, picks each word's lowest rank and merges all its occurrences from left to right; words without a
mergeable pair leave the array. The rounds are few, as all words advance together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

# The word pattern of the public vocabulary byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NO_RANK = np.int64(np.iinfo(np.int64).max)
CACHED_WORDS = 400_000
BATCH_CHARS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind, with the byte.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the code points from 256 on.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Sorted pair keys with their ranks and merged ids, and the id of each byte. About 50,000 entries: bounded."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids = model["vocab"]
        self.span = max(ids.values()) + 1
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in byte_alphabet().items():
            self.byte_ids[byte] = ids[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.span + ids[b] for a, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of the non-empty words."""
        size = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_symbols, done_words = [], []
        while len(symbols):
            key = symbols[:-1] * self.span + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.where(hit, self.ranks[at], NO_RANK)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            row = np.cumsum(np.append(False, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(np.append(rank, NO_RANK), start)
            finished = (lowest == NO_RANK)[row]
            if finished.any():
                done_symbols.append(symbols[finished])
                done_words.append(word[finished])
            chosen = hit & (rank == lowest[row[:-1]])
            # Of occurrences that overlap (a run of one symbol) every second one counts, from the left.
            i = np.flatnonzero(chosen)
            if len(i):
                fresh = np.append(True, np.diff(i) > 1)
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - first) % 2 == 0]
            symbols[i] = self.merged[at[i]]
            keep = ~finished
            keep[i + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return []
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")  # each word finished whole, in one round
        return np.split(symbols[order].astype(np.int32), np.cumsum(np.bincount(word, minlength=len(words)))[:-1])


def encoder(vocabulary: Vocabulary):
    """A function from texts (None allowed) to lists of ids; it keeps a bounded cache of words."""
    import regex

    pattern = regex.compile(PATTERN)
    known: dict[str, np.ndarray] = {}

    def encode(texts: list[str | None]) -> list[np.ndarray]:
        split = [pattern.findall(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in known})
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = list({w for words in split for w in words})
        if new:
            known.update(zip(new, vocabulary.encode_words([w.encode("utf-8", "surrogatepass") for w in new])))
        empty = np.empty(0, np.int32)
        return [np.concatenate([known[w] for w in words]) if words else empty for words in split]

    return encode


def encode_texts(df: DataFrame, key: str, text: str, vocabulary_path: str) -> DataFrame:
    """(key, ids): the token ids of every text; an empty or null text has an empty list.

    Strings that look like special tokens are ordinary text. The vocabulary is read once on the driver and broadcast
    (its size is that of the file, whatever the corpus). There is no shuffle; a text may have any length; repeated
    rows are encoded each on their own; an empty table gives no rows; extra columns are never read.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // BATCH_CHARS
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                ids = encode(batch.column(1).slice(a, b - a).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["k", "ids"])

    out = T.StructType([T.StructField("k", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(scan, out).withColumnRenamed("k", key)
