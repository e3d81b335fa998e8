"""The registered store queries seal by byte budget, as every append does."""

import pytest

from batchloom.plans import engine
from batchloom.sources import store


@pytest.mark.parametrize("name, appends", [("store_catalog", 1), ("store_range_scan", 1), ("s3_snapshot_freeze", 2)])
def test_store_queries_seal_by_budget(spark, monkeypatch, name, appends):
    calls, real = [], store.by_byte_budget
    monkeypatch.setattr(store, "by_byte_budget", lambda *a, **k: calls.append(a) or real(*a, **k))
    assert getattr(engine, name)(spark, "/root/testdata/sf0.001").count() >= 0
    assert len(calls) == appends
