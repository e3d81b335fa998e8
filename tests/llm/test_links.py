"""Passages of records that share their seeds with many others, against brute force over all pairs."""

import random

import numpy as np
import pytest

pytest.importorskip("batchloom.llm")

from batchloom.llm import chains  # noqa: E402
from batchloom.llm.spans import Flat, seeds  # noqa: E402


def some(r, n):
    return "".join(r.choice("abcdefghijklmnop ") for _ in range(n))


def brute_links(docs):
    """Pairs of records with a passage, by chaining all matches of all pairs."""
    places = {}
    for d, t in docs:
        flat = Flat([t])
        at, hashes = seeds(flat, flat.windows(chains.STRETCH), chains.STRETCH, chains.K)
        places[d] = sorted(set(zip(at.tolist(), hashes.tolist())))
    text, out = dict(docs), set()
    for a in places:
        for b in places:
            points = sorted((x, y) for x, h in places[a] for y, g in places[b] if h == g) if b < a else []
            if points:
                x, y = np.array(points, np.int64).T
                for c in chains.best_chains(x, y, chains.K, chains.GAP_COST, chains.LEAST_SCORE):
                    left, right = text[a][x[c[0]] : x[c[-1]] + chains.K], text[b][y[c[0]] : y[c[-1]] + chains.K]
                    if chains.common_subsequence(left, right) >= chains.LEAST_SHARE * max(len(left), len(right)):
                        out.add((a, b))
    return out


def joined(pairs):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in pairs:
        root[find(a)] = find(b)
    return find


def test_middle_records_meet_whose_seeds_stand_scattered_in_lower_ones(spark):
    r = random.Random(11)
    passage = some(r, 500)
    docs = [(i, some(r, 80) + passage[40 * i : 40 * i + 60] + some(r, 80)) for i in range(12)]
    docs += [(100, some(r, 90) + passage + some(r, 50)), (101, passage[:200] + "##" + passage[203:] + some(r, 70))]
    docs += [(200 + i, some(r, 80) + passage[40 * i : 40 * i + 60] + some(r, 80)) for i in range(12)]
    rows = chains.shared_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text").collect()
    best = max((x for x in rows if {x.doc_id, x.partner} == {100, 101}), key=lambda x: x.end - x.start)
    assert best.end - best.start > 400 and 0.9 < best.share < 1


@pytest.mark.parametrize("block, exact", [(20_000, False), (5, False), (20_000, True), (5, True)])
def test_links_are_connected(spark, monkeypatch, block, exact):
    monkeypatch.setattr(chains, "BLOCK_ROWS", block)
    r = random.Random(12)
    templates = [some(r, 260) for _ in range(4)]
    docs = []
    for d in range(90):
        parts = [some(r, r.randrange(60))]
        for t in r.sample(templates, r.randrange(1, 3)):
            a = r.randrange(0, 120, 10)
            part = list(t[a : a + r.randrange(40, 200)])
            for _ in range(r.randrange(4)):
                part[r.randrange(len(part))] = "#"
            parts += ["".join(part), some(r, r.randrange(60))]
        docs.append((d, "".join(parts)))
    rows = chains.shared_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", exact).collect()
    find, wanted = joined((x.doc_id, x.partner) for x in rows), brute_links(docs)
    lost = [p for p in wanted if find(p[0]) != find(p[1])]
    # Records here hold fragments of several first holders, the one case that only the exact form is sure to connect.
    assert len(wanted) > 100 and len(lost) <= (0 if exact else 0.02 * len(wanted))
    text = dict(docs)
    for x in rows:
        left, right = text[x.doc_id][x.start : x.end], text[x.partner][x.partner_start : x.partner_end]
        assert x.share == chains.common_subsequence(left, right) / max(len(left), len(right)) >= chains.LEAST_SHARE


def test_pairs_within(monkeypatch):
    r = random.Random(13)
    group = np.sort([r.randrange(6) for _ in range(70)])
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if group[i] == group[j]}
    for size in (1, 10, 10_000):
        monkeypatch.setattr(chains, "PAIRS", size)
        got = [(int(i), int(j)) for a, b in chains.pairs_within(group) for i, j in zip(a, b)]
        assert set(got) == want and len(got) == len(want)


def test_close_pairs():
    line, seed = np.array([0, 10, 100, 159, 160, 5000]), np.array([1, 2, 1, 3, 4, 4])
    i, j = chains.close_pairs(line, np.arange(6), seed)
    want = {(a, b) for a in range(6) for b in range(a + 1, 6) if line[b] - line[a] < chains.REACH and seed[a] != seed[b]}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_units_of_a_verbatim_stretch_agree():
    r = random.Random(14)
    passage = some(r, 300)
    flat = Flat([some(r, 70) + passage + some(r, 40), some(r, 31) + passage + some(r, 90), some(r, 400)])
    at, hashes = seeds(flat, flat.windows(chains.STRETCH), chains.STRETCH, chains.K)
    at = np.unique(at)
    unit, steps = chains.units(flat, at)
    shared = [set(unit[flat.text[at] == i].tolist()) - {0} for i in range(3)]
    assert len(shared[0] & shared[1]) >= 5 and not shared[2] & (shared[0] | shared[1])
    assert ((steps != 0) == (unit != 0)).all()
