"""Queries on data quality and skew (p1, p3, p4, p7) and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.compressed import per_key
from ..operators.dedup import first_deliveries, surplus
from ..operators.rolling import day_span, trailing_totals
from ..operators.spikes import bad_readings
from ..tables import table


def _readings(spark: SparkSession, base: str) -> DataFrame:
    found = bad_readings([
        (table(spark, base, "quotes"), "sym", "ts", "quote_id", ["bid_px", "ask_px"]),
        (table(spark, base, "trades"), "sym", "ts", "row_id", ["px"]),
    ])
    tbl = F.when(F.col("tbl") == 0, "quotes").otherwise("trades")
    field = F.when(F.col("tbl") == 1, "px").when(F.col("field") == 0, "bid_px").otherwise("ask_px")
    return found.select(tbl.alias("tbl"), "row_key", field.alias("field"), "impossible", "spike", "stuck")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return _readings(spark, base).select("tbl", "row_key", "field")


def p1_reasons(spark: SparkSession, base: str) -> DataFrame:
    return _readings(spark, base)


def p3_rolling(spark: SparkSession, base: str) -> DataFrame:
    trades = table(spark, base, "trades").select("sym", "ts", "sz", "trade_id", "row_id")
    once = first_deliveries(trades, "trade_id", ["row_id"]).select("sym", "ts", "sz")
    return trailing_totals(once, "sym", "ts", "sz", span=day_span(trades, "ts"))


def p4_per_sym(spark: SparkSession, base: str) -> DataFrame:
    quotes = per_key(table(spark, base, "quotes"), "sym", "ts", ["bid_px", "ask_px"])
    trades = per_key(table(spark, base, "trades"), "sym", "ts", ["px", "sz"])
    return quotes.select(F.lit("quotes").alias("tbl"), "*").unionAll(trades.select(F.lit("trades").alias("tbl"), "*"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return surplus(table(spark, base, "trades"), "trade_id", "row_id")


def p7_once(spark: SparkSession, base: str) -> DataFrame:
    return first_deliveries(table(spark, base, "trades"), "trade_id", ["row_id"])


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p3_rolling, p4_per_sym, p7_found, p7_once)}

_P1 = """
WITH readings AS (
  SELECT 'quotes' AS tbl, 'bid_px' AS field, sym, quote_id AS row_key, ts, bid_px AS v FROM quotes WHERE sym IS NOT NULL AND bid_px IS NOT NULL
  UNION ALL SELECT 'quotes', 'ask_px', sym, quote_id, ts, ask_px FROM quotes WHERE sym IS NOT NULL AND ask_px IS NOT NULL
  UNION ALL SELECT 'trades', 'px', sym, row_id, ts, px FROM trades WHERE sym IS NOT NULL AND px IS NOT NULL
), keyed AS (SELECT *, epoch_us(ts) // 86400000000 AS d FROM readings),
near AS (
  SELECT *, lag(v) OVER s AS prior, row_number() OVER s AS rn,
    CAST(median(v) OVER (s ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS before,
    CAST(median(v) OVER (s ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS DOUBLE) AS after,
    count(*) OVER (s ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n_before,
    count(*) OVER (s ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n_after
  FROM keyed WINDOW s AS (PARTITION BY tbl, field, sym, d ORDER BY ts, row_key)
), scale AS (
  SELECT tbl, field, sym, median(abs(v - prior)) FILTER (WHERE v <> prior) AS step,
    2 * count(*) FILTER (WHERE v <> prior) > count(prior) AS lively
  FROM near GROUP BY ALL
), runs AS (
  SELECT *, sum(CASE WHEN v = prior THEN 0 ELSE 1 END) OVER (PARTITION BY tbl, field, sym, d ORDER BY ts, row_key) AS run FROM near
), sized AS (SELECT *, count(*) OVER (PARTITION BY tbl, field, sym, d, run) AS run_n FROM runs),
judged AS (
  SELECT s.*, v <= 0 AS impossible,
    coalesce(n_before >= 3 AND n_after >= 3 AND ((v - before > 20 * step AND v - after > 20 * step) OR (before - v > 20 * step AND after - v > 20 * step)), false) AS spike,
    coalesce(run_n >= 15 AND lively, false) AS stuck
  FROM sized s JOIN scale USING (tbl, field, sym)
)
"""

SQL = {
    "p1_found": _P1 + "SELECT tbl, row_key, field FROM judged WHERE impossible OR spike OR stuck",
    "p1_reasons": _P1 + "SELECT tbl, row_key, field, impossible, spike, stuck FROM judged WHERE impossible OR spike OR stuck",
    "p3_rolling": """
WITH ends AS (SELECT min(epoch_us(ts) // 86400000000) AS lo, max(epoch_us(ts) // 86400000000) AS hi FROM trades),
once AS (
  SELECT sym, ts, sz FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY row_id) AS rn FROM trades) WHERE rn = 1 OR trade_id IS NULL
), daily AS (
  SELECT sym, epoch_us(ts) // 86400000000 AS d, coalesce(sum(sz), 0) AS s, count(sz) AS n FROM once WHERE sym IS NOT NULL AND ts IS NOT NULL GROUP BY ALL
), grid AS (SELECT sym, unnest(range(lo, hi + 1)) AS d FROM (SELECT DISTINCT sym FROM daily), ends),
sums AS (
  SELECT g.sym, g.d,
    CAST(coalesce(sum(s) FILTER (WHERE g.d - t.d < 7), 0) AS BIGINT) AS s7, CAST(coalesce(sum(n) FILTER (WHERE g.d - t.d < 7), 0) AS BIGINT) AS n7,
    CAST(coalesce(sum(s), 0) AS BIGINT) AS s30, CAST(coalesce(sum(n), 0) AS BIGINT) AS n30
  FROM grid g LEFT JOIN daily t ON t.sym = g.sym AND t.d BETWEEN g.d - 29 AND g.d GROUP BY g.sym, g.d
)
SELECT sym, DATE '1970-01-01' + CAST(d AS INTEGER) AS day, s7 AS sum_7d, n7 AS n_7d, s7 / 7.0::DOUBLE AS day_avg_7d, CASE WHEN n7 > 0 THEN s7::DOUBLE / n7 END AS avg_7d,
  s30 AS sum_30d, n30 AS n_30d, s30 / 30.0::DOUBLE AS day_avg_30d, CASE WHEN n30 > 0 THEN s30::DOUBLE / n30 END AS avg_30d
FROM sums""",
    "p4_per_sym": """
WITH readings AS (
  SELECT 'quotes' AS tbl, 'bid_px' AS field, sym, ts, bid_px AS v FROM quotes
  UNION ALL SELECT 'quotes', 'ask_px', sym, ts, ask_px FROM quotes
  UNION ALL SELECT 'trades', 'px', sym, ts, px FROM trades
  UNION ALL SELECT 'trades', 'sz', sym, ts, sz FROM trades
), base AS (
  SELECT tbl, field, sym, count(*) AS rows, count(v) AS "values", count(DISTINCT v) AS distinct_values, min(v) AS lowest, max(v) AS highest,
    CAST(sum(v) AS DECIMAL(38,0)) AS total, CAST(median(v) AS DOUBLE) AS median
  FROM readings GROUP BY ALL
), modes AS (
  SELECT tbl, field, sym, v AS mode FROM (
    SELECT tbl, field, sym, v, row_number() OVER (PARTITION BY tbl, field, sym ORDER BY count(*) DESC, v) AS rn FROM readings WHERE v IS NOT NULL GROUP BY tbl, field, sym, v) WHERE rn = 1
), lasts AS (
  SELECT tbl, field, sym, v AS last_value FROM (
    SELECT *, row_number() OVER (PARTITION BY tbl, field, sym ORDER BY ts DESC, v DESC) AS rn FROM readings WHERE v IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1
)
SELECT b.*, m.mode, l.last_value FROM base b
LEFT JOIN modes m ON m.tbl = b.tbl AND m.field = b.field AND m.sym IS NOT DISTINCT FROM b.sym
LEFT JOIN lasts l ON l.tbl = b.tbl AND l.field = b.field AND l.sym IS NOT DISTINCT FROM b.sym""",
    "p7_found": """
SELECT trade_id, row_id FROM (SELECT trade_id, row_id, min(row_id) OVER (PARTITION BY trade_id) AS least FROM trades WHERE trade_id IS NOT NULL)
WHERE row_id > least""",
    "p7_once": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY row_id) AS rn FROM trades) WHERE rn = 1 OR trade_id IS NULL""",
}
