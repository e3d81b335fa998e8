"""Chaining, alignment and paraphrase search against naive versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("batchloom.llm")

from batchloom.llm.chains import PrefixMaximum, best_chains, common_subsequence, shared_passages  # noqa: E402
from batchloom.llm.paraphrases import common, find_paraphrases, signatures, windows  # noqa: E402


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randrange(30))) for _ in range(2))
        assert common_subsequence(a, b) == naive_lcs(a, b)
        assert common(np.array([ord(c) for c in a], np.uint64), np.array([ord(c) for c in b], np.uint64)) == naive_lcs(a, b)


def test_prefix_maximum():
    r = random.Random(2)
    tree, values = PrefixMaximum(40), {}
    for i in range(300):
        at, v = r.randrange(40), r.random()
        tree.put(at, v, i)
        values[at] = max(values.get(at, -1), v)
        q = r.randrange(41)
        want = max([v for k, v in values.items() if k < q], default=float("-inf"))
        assert tree.before(q)[0] == want


@pytest.mark.parametrize("seed", range(8))
def test_best_chain_is_optimal(seed):
    r = random.Random(seed)
    points = sorted({(r.randrange(120), r.randrange(120)) for _ in range(60)})
    x, y = (np.array(c, np.int64) for c in zip(*points))
    k, cost = 16, 0.2
    score = []
    for i in range(len(x)):
        before = [score[j] - cost / 2 * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
        score.append(k + max([0.0, *before]))
    chains = best_chains(x, y, k, cost, k)
    first = chains[0]
    assert all(x[a] < x[b] and y[a] < y[b] for c in chains for a, b in zip(c, c[1:]))
    got = k * len(first) - cost / 2 * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
    assert got == pytest.approx(max(score))
    assert len({i for c in chains for i in c}) == sum(map(len, chains))


def test_passages_with_small_changes(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(60)]
    changed = list(base)
    changed[25], changed[40] = "zz", "qqqqqqq"
    other = lambda: " ".join(word() for _ in range(50))
    docs = [(1, other() + " " + " ".join(base)), (2, " ".join(changed) + " " + other()), (3, other()), (4, " ".join(base)), (5, None), (None, " ".join(base)), (6, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").select("*", F.lit(1).alias("id"), F.lit(2).alias("seed"))
    rows = shared_passages(df, "doc_id", "text").collect()
    assert {d for r in rows for d in (r.doc_id, r.partner)} == {1, 2, 4} and all(0.8 <= r.share <= 1 and r.partner < r.doc_id for r in rows)
    two = max((r for r in rows if 2 in (r.doc_id, r.partner)), key=lambda r: r.end - r.start)
    assert two.end - two.start > 350 and two.share < 1
    assert shared_passages(df.limit(0), "doc_id", "text").count() == 0


def test_windows_and_signatures():
    first, end, text = windows(np.array([0, 5, 32, 33, 70]), 32, 8)
    assert list(zip(first, end, text))[:4] == [(0, 5, 1), (5, 37, 2), (37, 69, 3), (38, 70, 3)]
    assert end.max() == 140 and set(end[text == 4] - first[text == 4]) == {32}
    flat = np.random.default_rng(0).integers(0, 1 << 63, 140).astype(np.uint64)
    assert (np.bitwise_count(signatures(flat, first, end)).sum(axis=1) <= end - first).all()


def test_paraphrases(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, [r.choice(vocabulary) for _ in range(40)], f"answer{i}") for i in range(5)]
    docs = []
    for d in range(80):
        docs.append((d, " ".join(r.choice(vocabulary) for _ in range(r.randrange(20, 150)))))
    reworded = [w if k % 7 else "other" for k, w in enumerate(items[2][1])]
    docs += [(500, docs[0][1] + " " + " ".join(reworded) + " answer2"), (501, " ".join(items[3][1])), (502, None), (None, " ".join(items[3][1])), (503, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    known = spark.createDataFrame([(i, " ".join(p), a) for i, p, a in items] + [(9, None, "x"), (10, "", None)], "item_id bigint, passage string, answer string")
    # In a vocabulary without any structure cosines fall with every word replaced or out of step.
    rows = find_paraphrases(df, "doc_id", "text", known, "item_id", "passage", "answer", cosine=0.5).collect()
    assert {(x.doc_id, x.item_id, x.has_answer) for x in rows} == {(500, 2, True), (501, 3, False)}
    assert {x.doc_id: x.share for x in rows}[501] == 1
    assert find_paraphrases(df, "doc_id", "text", known.limit(0), "item_id", "passage", "answer").count() == 0
    assert find_paraphrases(df.limit(0), "doc_id", "text", known, "item_id", "passage", "answer").count() == 0


def test_paraphrases_at_the_registered_cosine(spark):
    """Rewordings of 15% of an item's words, in texts of topics with their own vocabulary."""
    r = random.Random(16)
    topics = [[f"t{k}w{i}" for i in range(150)] for k in range(20)]
    usual = [f"the{i}" for i in range(80)]
    some = lambda k, n: [r.choice(topics[k]) if r.random() < 0.6 else usual[int(80 * r.random() ** 3)] for _ in range(n)]
    items = [(i, some(i % 20, r.choice([12, 20, 40, 60]))) for i in range(60)]
    docs = [(d, some(d % 20, r.randrange(40, 250))) for d in range(600)]
    planted = []
    for i, words in items:
        changed = list(words)
        for at in r.sample(range(len(words)), len(words) * 15 // 100):
            changed[at] = r.choice(topics[i % 20])
        d = r.randrange(600)
        docs[d][1][10:10] = changed
        planted.append((d, i))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, " ".join(w), w[0]) for i, w in items], "item_id bigint, passage string, answer string")
    rows = find_paraphrases(df, "doc_id", "text", known, "item_id", "passage", "answer").collect()
    found = {(x.doc_id, x.item_id) for x in rows}
    assert len(set(planted) & found) >= 0.9 * len(planted)
    assert all(x.share >= 0.7 for x in rows)


def test_leading_singular_vectors():
    from batchloom.llm.leaks import leading

    g = np.random.default_rng(17)
    left, right = np.linalg.qr(g.standard_normal((400, 60)))[0], np.linalg.qr(g.standard_normal((300, 60)))[0]
    a = left * (0.5 ** np.arange(60)) @ right.T
    start = np.linalg.qr(g.standard_normal((300, 18)))[0]
    got = leading(start, a.T @ (a @ start), 10)
    assert np.allclose(got.T @ got, np.eye(10), atol=1e-8)
    assert np.abs((got * right[:, :10]).sum(axis=0))[:6].min() > 0.999


def test_sums_by_rounds(spark):
    from batchloom.llm.leaks import _add_up

    def emit(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array([np.full(3, 1.0).tobytes(), np.full(3, 2.0).tobytes()])], names=["part", "share"])

    rows = spark.range(0, 70, numPartitions=70).mapInArrow(emit, "part int, share binary")
    assert _add_up(rows, 70).tolist() == [70.0] * 3 + [140.0] * 3
