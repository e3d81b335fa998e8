"""Registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timeexpr import utc_day
from ..tables import table
from .bpe import encode_texts
from .chains import shared_passages
from .leaks import find_leaks
from .nearest import nearest
from .paraphrases import find_paraphrases
from .percentiles import combine, quantiles, summarise
from .runs import collapse_runs
from .spans import shared_spans

PROBABILITIES = [0.5, 0.9, 0.99, 0.999]
SMALL = 16  # values of a buffer in p5_bounds
TOKENIZERS = os.environ.get("BATCHLOOM_TOKENIZERS", "/opt/tokenizers")


def _runs(spark: SparkSession, base: str) -> DataFrame:
    return collapse_runs(table(spark, base, "quotes"), "sym", "ts", "quote_id", ["bid_px", "ask_px"])


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return _runs(spark, base).select(F.col("entity").alias("sym"), F.col("first_key").alias("first_quote_id"), F.col("last_key").alias("last_quote_id"))


def p2_runs(spark: SparkSession, base: str) -> DataFrame:
    return _runs(spark, base).select(F.col("entity").alias("sym"), F.col("first_key").alias("first_quote_id"), F.col("last_key").alias("last_quote_id"), "n", "seconds")


def _values(spark: SparkSession, base: str) -> DataFrame:
    """Prices and sizes of trades one below the other, with their UTC day."""
    readings = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("v")) for f in ("px", "sz")]))
    return table(spark, base, "trades").select("sym", utc_day(F.unix_micros("ts")).alias("day"), readings.alias("r")).select("r.field", "sym", "day", "r.v")


def _shown(summaries: DataFrame) -> DataFrame:
    q = quantiles(summaries, ["field", "sym"], PROBABILITIES)
    names = ["p" + f"{100 * p:g}".replace(".", "_") for p in PROBABILITIES]
    return q.select("field", "sym", "n", F.col("error").alias("rank_error"), *[F.col("q")[i].alias(c) for i, c in enumerate(names)])


def p5_percentiles(spark: SparkSession, base: str) -> DataFrame:
    """Per field and sym, over the summaries of all partitions."""
    return _shown(combine(summarise(_values(spark, base), ["field", "sym"], "v"), ["field", "sym"]))


def p5_from_days(spark: SparkSession, base: str) -> DataFrame:
    """The same by way of summaries per field, sym and day, combined over the days."""
    daily = combine(summarise(_values(spark, base), ["field", "sym", "day"], "v"), ["field", "sym", "day"])
    return _shown(combine(daily, ["field", "sym"], per_key=366))


def p5_bounds(spark: SparkSession, base: str) -> DataFrame:
    """Summaries of buffers so small that they collapse many times: whether each percentile lies within its stated bound
    of its exact rank."""
    values = _values(spark, base).where("v IS NOT NULL")
    q = quantiles(combine(summarise(values, ["field", "sym"], "v", SMALL), ["field", "sym"], SMALL), ["field", "sym"], PROBABILITIES)
    q = q.withColumnsRenamed({"field": "f", "sym": "s"})
    met = values.join(q, F.expr("field = f AND sym <=> s"))
    counts = met.groupBy("field", "sym", "n", "error", "q").agg(*[F.count_if(F.col("v") < F.col("q")[i]).alias(f"below{i}") for i in range(len(PROBABILITIES))], *[F.count_if(F.col("v") <= F.col("q")[i]).alias(f"upto{i}") for i in range(len(PROBABILITIES))])
    rank = [F.greatest(F.lit(1).cast("bigint"), F.ceil(F.round(F.lit(p) * F.col("n"), 9))) for p in PROBABILITIES]
    near = [(F.col(f"below{i}") + 1 - F.col("error") <= r) & (F.col(f"upto{i}") + F.col("error") >= r) for i, r in enumerate(rank)]
    levels = F.greatest(F.ceil(F.log2(F.col("n") / F.lit(float(SMALL)))), F.lit(0))
    small = F.col("error") <= F.col("n") * levels / F.lit(2.0 * SMALL)
    return counts.select("field", "sym", "n", (F.col("error") > 0).alias("collapsed"), small.alias("bound_is_small"), *[c.alias(f"within{i}") for i, c in enumerate(near)])


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    quotes = table(spark, base, "quotes").where("bid_px IS NOT NULL")
    return nearest(table(spark, base, "trades"), quotes, "sym", "ts", "row_id", "quote_id").select("row_id", "quote_id")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_texts(table(spark, base, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return find_leaks(table(spark, base, "documents"), "doc_id", "text", table(spark, base, "test_items"), "item_id", "passage")


def p9_paraphrases(spark: SparkSession, base: str) -> DataFrame:
    return find_paraphrases(table(spark, base, "documents"), "doc_id", "text", table(spark, base, "test_items"), "item_id", "passage", "answer")


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return shared_spans(table(spark, base, "documents"), "doc_id", "text")


def p10_passages(spark: SparkSession, base: str) -> DataFrame:
    return shared_passages(table(spark, base, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_runs, p5_percentiles, p5_from_days, p5_bounds, p6_found, p8_ids, p9_found, p9_paraphrases, p10_found, p10_passages)}

_P2 = """
WITH q AS (SELECT *, lag(ts) OVER s AS t0, lag(bid_px) OVER s AS b0, lag(ask_px) OVER s AS a0 FROM quotes WHERE sym IS NOT NULL WINDOW s AS (PARTITION BY sym ORDER BY ts, quote_id)),
f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(t0) <= 60000000
    AND ((bid_px IS NULL AND b0 IS NULL) OR abs(bid_px - b0) <= 2) AND ((ask_px IS NULL AND a0 IS NULL) OR abs(ask_px - a0) <= 2) THEN 0 ELSE 1 END AS new FROM q),
r AS (SELECT *, sum(new) OVER (PARTITION BY sym ORDER BY ts, quote_id) AS run FROM f),
runs AS (
  SELECT sym, arg_min(quote_id, (ts, quote_id)) AS first_quote_id, arg_max(quote_id, (ts, quote_id)) AS last_quote_id, count(*) AS n,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS seconds
  FROM r GROUP BY sym, run HAVING count(*) > 1
)
"""

# Up to 65,536 values of a group its summary is exact, and its rank error 0: so for every sym at the scale of this check.
_P5 = """
SELECT field, sym, count(v) AS n, CAST(0 AS BIGINT) AS rank_error, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.99) AS p99, quantile_disc(v, 0.999) AS p99_9
FROM (SELECT 'px' AS field, sym, px AS v FROM trades UNION ALL SELECT 'sz', sym, CAST(sz AS BIGINT) FROM trades) WHERE v IS NOT NULL GROUP BY field, sym"""

_P10 = """
WITH windows AS (SELECT doc_id, s, substring(text, s + 1, 100) AS g FROM (SELECT doc_id, text, unnest(range(0, length(text) - 99)) AS s FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 100)),
shared AS (SELECT doc_id, s FROM windows WHERE g IN (SELECT g FROM windows GROUP BY g HAVING min(doc_id) <> max(doc_id))),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM shared),
spans AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked)
SELECT doc_id, min(s) AS span_start, max(s) + 100 AS span_end FROM spans GROUP BY doc_id, span"""

SQL = {
    "p10_found": _P10,
    "p2_found": _P2 + "SELECT sym, first_quote_id, last_quote_id FROM runs",
    "p2_runs": _P2 + "SELECT sym, first_quote_id, last_quote_id, n, seconds FROM runs",
    "p5_percentiles": _P5,
    "p5_from_days": _P5,
    # Two full buffers of 16 values collapse; every value returned must then lie within the tracked bound of its rank.
    "p5_bounds": """
SELECT field, sym, count(v) AS n, count(v) >= 32 AS collapsed, true AS bound_is_small, true AS within0, true AS within1, true AS within2, true AS within3
FROM (SELECT 'px' AS field, sym, px AS v FROM trades UNION ALL SELECT 'sz', sym, CAST(sz AS BIGINT) FROM trades) WHERE v IS NOT NULL GROUP BY field, sym""",
    "p6_found": """
WITH q AS (SELECT sym, ts, min(quote_id) AS quote_id FROM quotes WHERE sym IS NOT NULL AND bid_px IS NOT NULL AND quote_id IS NOT NULL GROUP BY sym, ts),
t AS (SELECT row_id, sym, ts FROM trades WHERE sym IS NOT NULL),
near AS (
  SELECT t.row_id, q.quote_id, q.ts AS q_ts, abs(epoch_us(t.ts) - epoch_us(q.ts)) AS d FROM t ASOF JOIN q ON t.sym = q.sym AND t.ts >= q.ts
  UNION ALL SELECT t.row_id, q.quote_id, q.ts, abs(epoch_us(t.ts) - epoch_us(q.ts)) FROM t ASOF JOIN q ON t.sym = q.sym AND t.ts <= q.ts
)
SELECT row_id, quote_id FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, q_ts) AS rn FROM near WHERE d <= 1000000) WHERE rn = 1""",
}
