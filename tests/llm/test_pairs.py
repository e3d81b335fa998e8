"""Every pair of records with a passage is reported for itself, against brute force over all pairs."""

import random

import numpy as np
import pytest

pytest.importorskip("batchloom.llm")

from batchloom.llm import chains  # noqa: E402
from batchloom.llm.spans import _BASE  # noqa: E402

from .test_links import brute_links, some  # noqa: E402


def corpus():
    """A footer that many records hold, at times with a slip, a run of one letter, a quote with seeds far apart."""
    r = random.Random(21)
    footer, quote = some(r, 130), some(r, 420)
    docs = []
    for d in range(40):
        end = list(footer)
        if d % 5 == 0:
            end[r.randrange(130)] = "#"
        docs.append((d, some(r, r.randrange(20, 90)) + "".join(end) + some(r, r.randrange(20))))
    docs += [(50 + d, some(r, 60) + "z" * (54 + d) + some(r, 30)) for d in range(4)]
    for d in range(6):
        part = list(quote)
        for at in range(r.randrange(30), 420, 30):
            part[at] = "#"
        docs.append((60 + d, some(r, 40) + "".join(part) + footer))
    return docs


@pytest.mark.parametrize("group", [200_000, 20])
def test_no_pair_is_left_out(spark, monkeypatch, group):
    monkeypatch.setattr(chains, "GROUP_ROWS", group)
    docs = corpus()
    rows = chains.shared_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text").collect()
    wanted = brute_links(docs)
    assert len(wanted) > 700 and {(x.doc_id, x.partner) for x in rows} >= wanted
    assert {(a, b) for a in range(51, 54) for b in range(50, a)} <= {(x.doc_id, x.partner) for x in rows}
    assert len(rows) == len(set(rows))
    text = dict(docs)
    for x in rows:
        left, right = text[x.doc_id][x.start : x.end], text[x.partner][x.partner_start : x.partner_end]
        assert x.partner < x.doc_id and x.share == chains.common_subsequence(left, right) / max(len(left), len(right)) >= chains.LEAST_SHARE


def test_rows_that_share_a_key(spark):
    r = random.Random(23)
    first, second = some(r, 300), some(r, 300)
    slip = lambda t: t[:140] + "##" + t[143:]
    docs = [(5, first), (5, second), (2, slip(first)), (3, slip(second)), (3, first[:200])]
    rows = chains.shared_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text").collect()
    best = {p: max((x for x in rows if (x.doc_id, x.partner) == p), key=lambda x: x.end - x.start) for p in [(5, 2), (5, 3), (3, 2)]}
    assert all(x.end - x.start > 150 for x in best.values()) and best[5, 2].share < 1
    left, right = first[best[5, 2].start : best[5, 2].end], slip(first)[best[5, 2].partner_start : best[5, 2].partner_end]
    assert best[5, 2].share == chains.common_subsequence(left, right) / max(len(left), len(right))


@pytest.mark.parametrize("points", [1, 50, 1_000_000])
@pytest.mark.parametrize("packed", [True, False])
def test_meetings(monkeypatch, points, packed):
    monkeypatch.setattr(chains, "POINTS", points)
    r = random.Random(22)
    sides = [np.array([(r.randrange(12), r.randrange(10), r.randrange(300), 0) for _ in range(n)], np.int64) for n in (120, 90, 0)]
    a, b, none = (chains.Side(rows.reshape(-1, 4)) for rows in sides)
    for one, other in [(a, b), (b, a), (a, a), (a, none), (none, a)]:
        if not packed:
            monkeypatch.setattr(one, "longest", 1 << 62)
        want = [(i, j) for i in range(len(one.id)) for j in range(len(other.id)) if one.seed[i] == other.seed[j] and other.id[j] < one.id[i]]
        pairs = [(one.id[i], other.id[j]) for i, j in want]
        want = {w for w, p in zip(want, pairs) if pairs.count(p) >= chains.FEWEST}
        got = [(int(x), int(y)) for i, j in chains.meetings(one, other) for x, y in zip(i, j)]
        assert set(got) == want and len(got) == len(want)
        assert got == sorted(got, key=lambda m: (one.id[m[0]], other.id[m[1]], *m))


def test_powers():
    at = np.array([0, 1, 65_535, 65_536, 3_000_000])
    assert chains.powers(_BASE, at).tolist() == [pow(_BASE, int(e), 1 << 64) for e in at]
    assert len(chains.powers(_BASE, np.empty(0, np.int64))) == 0
