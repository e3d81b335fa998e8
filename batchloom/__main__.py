"""Command line: ``python -m batchloom {backfill,live,status} FOLDER [options]``."""

from __future__ import annotations

import argparse
import time


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="batchloom", description=__doc__)
    p.add_argument("what", choices=["backfill", "live", "status"])
    p.add_argument("folder", help="base folder of the tables quotes and trades")
    p.add_argument("--days", type=int, default=3, help="completed days to write, ending yesterday")
    p.add_argument("--events", type=int, default=50_000, help="events a day")
    p.add_argument("--rate", type=int, default=50, help="events a second")
    p.add_argument("--seconds", type=float, default=10, help="how long to feed")
    p.add_argument("--symbols", type=int, default=100)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--cycle", default="1h", help="roll cycle, such as 30m, 4h or 1d")
    p.add_argument("--batch-rows", type=int, default=4096)
    p.add_argument("--max-batches", type=int, default=256)
    p.add_argument("--keep", type=int, help="segments to retain")
    p.add_argument("--threshold", type=float, default=1.0, help="seconds without a heartbeat that count as stalled")
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession, functions as F

    from .sources.feed import backfill
    from .sources.spec import quotes_spec, trades_spec
    from .sources.store import TableStore
    from .streaming.sink import append_stream, live_feed, status

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("batchloom").getOrCreate()
    make = lambda name, spec, rotation: TableStore.create(spark, f"{a.folder}/{name}", spec, cycle=a.cycle, max_batches=a.max_batches, rotation_time=rotation)
    if a.what == "backfill":
        yesterday = (int(time.time()) // 86_400 - 1) * 86_400_000_000
        data = backfill(spark, a.days, a.events, yesterday, seed=a.seed, symbols=a.symbols)
        stores = [make("quotes", quotes_spec(a.batch_rows), "event"), make("trades", trades_spec(a.batch_rows), "event")]
        epoch = max(s.open_writer() for s in stores)
        for store, df, order in zip(stores, data, ("quote_id", "trade_id")):
            store.epoch = epoch
            store.append(df, [order])
            store.close()
    elif a.what == "live":
        store = make("quotes", quotes_spec(a.batch_rows), "processing")
        feed = live_feed(spark, a.rate).select("n", "ts", "sym", F.col("px").alias("bid_px"), (F.col("px") + 100).alias("ask_px"), F.lit(100).alias("bid_sz"), F.lit(100).alias("ask_sz"), F.lit("LIVE").alias("venue"))
        query = append_stream(feed, store, ["n"], f"{a.folder}/_checkpoint", "live", interval="100 milliseconds")
        until = time.time() + a.seconds
        while time.time() < until and query.isActive:
            query.awaitTermination(0.1)
            store.heartbeat()
        query.stop()
        store.close()
        if a.keep:
            store.retain(a.keep)
    for name in ("quotes", "trades"):
        store = TableStore(spark, f"{a.folder}/{name}", cycle=a.cycle)
        if store.files.exists("spec.json"):
            print(name, store.snapshot().count(), "rows,", len(store.versions()), "commits,", status(store, a.threshold))


if __name__ == "__main__":
    main()
