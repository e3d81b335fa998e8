"""Encoding, leaks and shared spans against the public tokenizer and brute force, with every defined edge case."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("batchloom.llm")

from batchloom.llm import spans  # noqa: E402
from batchloom.llm.bpe import Vocabulary, encode_texts, encoder  # noqa: E402
from batchloom.llm.leaks import find_leaks  # noqa: E402
from batchloom.llm.registry import TOKENIZERS  # noqa: E402
from batchloom.llm.words import normalise, words  # noqa: E402

BPE = f"{TOKENIZERS}/byte_bpe_50k.json"


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("id"), F.lit("x").alias("t"), F.lit(2).alias("item_id"), F.lit(3).alias("bucket"))


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_bpe_matches_the_public_tokenizer(spark):
    r = random.Random(3)
    texts = ["", None, "  ", "\n\n\t x ", "<|endoftext|> is text", "a" * 3000, "ab" * 700, "日本語のテキスト", "Ünïcödé ½ ²", "don't I'LL we've", "\x00\x01\x7f", "👍🏽" * 9, "é"] + ["".join(r.choice("abcdefg  éß漢1.,'\n") for _ in range(r.randrange(200))) for _ in range(200)]
    want = reference(texts)
    assert [list(x) for x in encoder(Vocabulary(BPE))(texts)] == want
    df = documents(spark, list(enumerate(texts)) + [(0, ""), (None, "null key")])
    got = encode_texts(df, "doc_id", "text", BPE)
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "ids:array<int>"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2 and {r.doc_id: r.ids for r in rows if r.doc_id is not None} == dict(enumerate(want))
    assert encode_texts(documents(spark, []), "doc_id", "text", BPE).count() == 0


@pytest.mark.parametrize("text, want", [
    ("Don't&nbsp;STOP", "don t stop"), ("a&amp;amp;lt;b&amp;amp;gt;c", "ac"), ("a&amp;lt;br&amp;gt;c", "a c"), ("so­ft zero​width", "soft zerowidth"), ("<p>One<br/>two</p><b>th</b>ree", "one two three"),
    ("[quote=Some One]x[/quote] [i]y[/i] [1] [deleted]", "x y 1 deleted"), ("ﬁne ①②", "fine 12"), ("3 < 4 and 5 > 4", "3 4 and 5 4"), ("> quoted\n>> twice", "quoted twice"), ("STRASSE straße", "strasse strasse"), ("_under_score", "under score"),
])
def test_words(text, want):
    assert words(text) == want.split()


def test_normalising_is_stable():
    for text in ("&amp;#173;a", "<b>x</b>", "ÀÉ ﬁ &lt;i&gt;z&lt;/i&gt;"):
        assert normalise(normalise(text)) == normalise(text)
    assert words(None) == words("") == words("...") == []


def brute_leaks(docs, items, run=13):
    out = set()
    for i, passage in items:
        w = words(passage)
        n = min(run, len(w))
        grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
        for d, text in docs:
            t = words(text)
            if d is not None and any(tuple(t[j : j + n]) in grams for j in range(len(t) - n + 1)):
                out.add((d, i))
    return out


def test_leaks(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(r.choice([1, 2, 3, 4, 6, 9, 12, 13, 14, 40])))) for i in range(60)] + [(100, ""), (101, None), (102, "?!"), (103, "w1 " * 20)]
    docs = []
    for d in range(300):
        text = some(r.randrange(120))
        if d % 3:
            source = items[r.randrange(60)][1].split()
            n = r.choice([12, 13, 14, len(source)])
            a = r.randrange(max(1, len(source) - n + 1))
            at = r.randrange(len(text) + 1)
            text[at:at] = source[a : a + n]
        docs.append((d, r.choice([" ", "​ ", ", <b>", "&nbsp;"]).join(text).upper()))
    docs += [(900, None), (901, ""), (902, "w1 " * 13), (902, "w1 " * 12), (None, "w1 " * 13), (903, "filler " * 30_000 + items[0][1])]
    frame = spark.createDataFrame(items, "item_id bigint, passage string").withColumn("doc_id", F.lit(1))
    rows = find_leaks(documents(spark, docs), "doc_id", "text", frame, "item_id", "passage").collect()
    assert {tuple(x) for x in rows} == brute_leaks(docs, items) and len(rows) == len(set(rows)) > 100
    assert find_leaks(documents(spark, []), "doc_id", "text", frame, "item_id", "passage").count() == 0
    assert find_leaks(documents(spark, docs), "doc_id", "text", frame.limit(0), "item_id", "passage").count() == 0


def brute_spans(docs, length):
    owners = defaultdict(set)
    for d, t in docs:
        for s in range(len(t) - length + 1) if d is not None and t else ():
            owners[t[s : s + length]].add(d)
    shared = defaultdict(set)
    for d, t in docs:
        for s in range(len(t) - length + 1) if d is not None and t else ():
            if len(owners[t[s : s + length]]) > 1:
                shared[d].update(range(s, s + length))
    out = set()
    for d, at in shared.items():
        at = sorted(at)
        start = at[0]
        for x, y in zip(at, at[1:] + [None]):
            if y != x + 1:
                out.add((d, start, x + 1))
                start = y
    return out


@pytest.mark.parametrize("length, seed, points, rows_of_a_seed", [(20, 8, 2_000_000, 4096), (20, 8, 64, 4096), (30, 30, 500, 3), (100, 40, 2_000_000, 4096), (20, 5, 200, 0)])
def test_shared_spans(spark, monkeypatch, length, seed, points, rows_of_a_seed):
    r = random.Random(length + points)
    pool = ["".join(r.choice("abcd é漢👍") for _ in range(160)) for _ in range(6)] + ["z" * 150, "xy" * 80]
    docs = []
    for d in range(120):
        parts = []
        for _ in range(r.randrange(5)):
            p = r.choice(pool)
            a = r.randrange(100)
            parts += [p[a : a + r.randrange(150)], "".join(r.choice("efgh") for _ in range(r.randrange(30)))]
        docs.append((d, "".join(parts)))
    docs += [(500, None), (501, ""), (None, pool[0]), (502, pool[1]), (503, pool[1]), (504, "own " * 300)]
    found = list(pieces_of(docs, length, points))
    assert {(i, b + j, p[j : j + length]) for i, b, p in found for j in range(len(p) - length + 1)} == {(d, s, t[s : s + length]) for d, t in docs if d is not None and t for s in range(len(t) - length + 1)}
    monkeypatch.setattr(spans, "OPEN_ROWS", rows_of_a_seed)
    rows = spans.shared_spans(documents(spark, docs), "doc_id", "text", length, seed, points).collect()
    assert {tuple(x) for x in rows} == brute_spans(docs, length) and len(rows) == len(set(rows)) >= 20


def pieces_of(docs, length, points):
    import pyarrow as pa

    rows = [(d, t) for d, t in docs if d is not None and t is not None]
    batch = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], names=["id", "t"])
    for ids, base, parts in spans._pieces(iter([batch]), length - 1, points):
        yield from zip(ids, base, parts)


def test_spans_of_copies_and_nothing(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(260))
    docs = [(1, text), (2, text), (3, text + "!"), (4, text[:99]), (5, text[7:107]), (1, text)]
    got = {tuple(r) for r in spans.shared_spans(documents(spark, docs), "doc_id", "text").collect()}
    assert got == {(1, 0, 260), (2, 0, 260), (3, 0, 260), (5, 0, 100)}
    assert spans.shared_spans(documents(spark, [(1, text), (1, text)]), "doc_id", "text").count() == 0
    assert spans.shared_spans(documents(spark, []), "doc_id", "text").count() == 0


@pytest.mark.parametrize("points, rows_of_a_seed", [(2_000_000, 4096), (700, 5)])
def test_spans_around_a_seed_of_a_third_of_all_rows(spark, monkeypatch, points, rows_of_a_seed):
    monkeypatch.setattr(spans, "OPEN_ROWS", rows_of_a_seed)
    r = random.Random(21)
    some = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    common, left, right = some(14), some(9), some(9)
    docs = []
    for d in range(500):
        before, after = some(25), some(25)
        if d % 3 == 0:
            before = before[:16] + (left if r.random() < 0.5 else left[r.randrange(9) :].rjust(9, r.choice("xyz")))
            after = (right[: r.randrange(10)] + after)[:25]
            docs.append((d, before + common + after))
        elif d % 3 == 1:
            docs.append((d, some(70)))
        else:
            docs.append((d, before + common[: r.randrange(14)] + after))
    docs += [(600 + d, docs[0][1]) for d in range(150)]  # and one text on many rows
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    rows = spans.shared_spans(frame, "doc_id", "text", 20, 6, points).collect()
    assert {tuple(x) for x in rows} == brute_spans(docs, 20) and len(rows) == len(set(rows)) > 200
