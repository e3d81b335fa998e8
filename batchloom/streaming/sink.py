"""Structured Streaming into a table store, and the liveness of its writer."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import TableStore


def append_stream(stream: DataFrame, store: TableStore, order: list[str], checkpoint: str, name: str, once: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Append every micro-batch exactly once; one query per table.

    A replayed micro-batch is recognised by (query name, batch id) in the table's log. Rows become visible when their
    micro-batch commits; those of a failed one never do.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, order, source=(name, batch_id))
        store.heartbeat()

    store.open_writer()
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def append_two(stream: DataFrame, routes: list[tuple[TableStore, str, list[str]]], checkpoint: str, name: str, once: bool = False) -> StreamingQuery:
    """One stream into several tables, each with its own filter and order; the tables share an epoch."""
    epoch = max(store.open_writer() for store, _, _ in routes)
    for store, _, _ in routes:
        store.epoch = epoch

    def write(batch: DataFrame, batch_id: int) -> None:
        for store, condition, order in routes:
            store.append(batch.where(condition), order, source=(name, batch_id))
            store.heartbeat()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_feed(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """An unbounded feed (n, ts, sym, px) at a given rate."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.col("value").alias("n"), F.col("timestamp").alias("ts"), F.format_string("S%03d", F.pmod("value", F.lit(512))).alias("sym"), (F.lit(1_000_000) + F.pmod(F.xxhash64("value"), F.lit(1000))).alias("px"))


def status(store: TableStore, threshold_seconds: float, now_us: int | None = None, since: dict | None = None) -> dict:
    """The writer's state: ALIVE, STALLED (no heartbeat for the threshold or longer), STUCK (heartbeats, but the same
    unfinished batch as in ``since``, an earlier status) or NONE without any heartbeat."""
    beat = json.loads(store.files.read("_heartbeat.json") or "{}")
    now = int(time.time() * 1e6) if now_us is None else now_us
    tail = store.tail()
    out = {"epoch": beat.get("epoch"), "beats": beat.get("beats", 0), "open_rows": tail.rows if tail.open else 0, "version": max(store.versions(), default=0)}
    if not beat:
        return out | {"state": "NONE", "idle_seconds": None}
    idle = (now - beat["at_us"]) / 1e6
    state = "STALLED" if idle >= threshold_seconds else "ALIVE"
    if state == "ALIVE" and since and since["beats"] < out["beats"] and since["version"] == out["version"] and out["open_rows"]:
        state = "STUCK"
    return out | {"state": state, "idle_seconds": idle}
