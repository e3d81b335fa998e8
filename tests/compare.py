"""Spark query against SQL on the same tables: python -m tests.compare [--sf DIR] [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter


def connection(base: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{base}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def differences(df, con, sql: str) -> list[str]:
    """What differs between the rows of a DataFrame and of a SQL query; empty if nothing."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    order = sorted(names)
    # Through pandas-free Arrow, as collect() of many rows is slow.
    table = df.select(*[f"`{c}`" for c in order]).toArrow()
    ours = Counter(tuple(map(plain, r)) for r in zip(*[c.to_pylist() for c in table.columns])) if table.num_columns else Counter()
    at = [names.index(c) for c in order]
    other = Counter(tuple(plain(r[i]) for i in at) for r in theirs)
    out = []
    if ours != other:
        out += [f"{sum(ours.values())} rows against {sum(other.values())}", f"only in Spark: {list((ours - other).items())[:3]}", f"only in SQL: {list((other - ours).items())[:3]}"]
    return out


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    base = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        base, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connection(base), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            df = f(spark, base)
            found = differences(df, con, sql[name]) if name in sql else [] if df.count() >= 0 else ["?"]
        except Exception as e:
            found = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok' if name in sql else 'ok (no SQL)'} {name} {time.time() - began:.1f}s", *found, sep="\n   " if found else " ", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
