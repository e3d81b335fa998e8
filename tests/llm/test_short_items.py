"""Short evaluation passages within long documents, at the cosine of production."""

import random

import pytest

pytest.importorskip("batchloom.llm")

from batchloom.llm.paraphrases import find_paraphrases  # noqa: E402


def test_short_passages_in_long_documents(spark):
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(600)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate((4, 7, 11, 16, 20, 25, 31))]
    docs, want = [(d, " ".join(some(150))) for d in range(60)], set()
    for d, (i, passage) in enumerate(items, 100):
        text = some(150)
        at = r.randrange(150)
        text[at:at] = passage
        docs.append((d, " ".join(text)))
        want.add((d, i, 1.0))
        if len(passage) > 10:
            text = some(150)
            text[at:at] = [w if k % 8 else "other" for k, w in enumerate(passage)]
            docs.append((d + 100, " ".join(text)))
            want.add((d + 100, i, sum(k % 8 > 0 for k in range(len(passage))) / len(passage)))
    known = spark.createDataFrame([(i, " ".join(p), "") for i, p in items], "item_id bigint, passage string, answer string")
    rows = find_paraphrases(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", known, "item_id", "passage", "answer").collect()
    assert {(x.doc_id, x.item_id, x.share) for x in rows if x.doc_id >= 100} == want
