"""SQL of the engine's queries, for a database with the same tables."""

from __future__ import annotations

_FEED = """
WITH feed AS (SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, props, CAST(round(value * 10000) AS BIGINT) AS px FROM events),
placed AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM feed),
batched AS (SELECT *, pos // 256 AS batch FROM placed),
zones AS (
  SELECT *, batch < max(batch) OVER () AS sealed FROM (
    SELECT batch, count(*) AS row_count, min(ts) AS ts_min, max(ts) AS ts_max, min(user_id) AS stat_min, max(user_id) AS stat_max FROM batched GROUP BY batch)
),
cycles AS (SELECT *, ts - ts % 14400000000 AS interval_start FROM feed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY interval_start ORDER BY event_id) - 1 AS pos FROM cycles),
rotated AS (SELECT *, pos // 2048 AS segment_seq, pos // 256 % 8 AS batch FROM ranked),
segments AS (SELECT interval_start // 60000000 AS start_minute, 240 AS cycle, segment_seq, count(*) AS row_count FROM rotated GROUP BY ALL),
ids AS (SELECT *, (start_minute << 31) | (CAST(240 AS BIGINT) << 15) | segment_seq AS id FROM segments),
named AS (SELECT *, strftime(make_timestamp(start_minute * 60000000), '%Y%m%d') || printf('.%02d%02d.240m.%d.seg', start_minute % 1440 // 60, start_minute % 60, segment_seq) AS name FROM segments),
span AS (SELECT min(ts) + (max(ts) - min(ts)) * 20 // 100 AS lo, min(ts) + (max(ts) - min(ts)) * 25 // 100 AS hi FROM feed)
"""

# Quotes as the store places them: by day (nulls: the present interval, of which there are none), 8,192 rows a batch.
_STORE = """
WITH q AS (SELECT *, epoch_us(ts) AS t, epoch_us(ts) // 86400000000 * 86400000000 AS interval_start FROM quotes),
p AS (SELECT *, row_number() OVER (PARTITION BY interval_start ORDER BY quote_id) - 1 AS pos FROM q)
"""

_BUDGET = """
WITH RECURSIVE sized AS (
  SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, coalesce(strlen(props), 0) AS len, sum(coalesce(strlen(props), 0)) OVER (ORDER BY event_id) AS upto FROM events
), ends AS MATERIALIZED (SELECT upto, min(pos) AS pos FROM sized GROUP BY upto),
pointers AS MATERIALIZED (
  SELECT s.pos, least(s.pos + 256, coalesce(e.pos, s.pos + 256)) AS next FROM (SELECT *, upto - len + 2048 AS reach FROM sized) s ASOF LEFT JOIN ends e ON s.reach < e.upto
), starts AS (
  SELECT CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS batch
  UNION ALL SELECT p.next, batch + 1 FROM starts s JOIN pointers p ON p.pos = s.pos WHERE p.next <= (SELECT max(pos) FROM sized)
)
, spans AS (SELECT batch, pos, lead(pos, 1, 9223372036854775807) OVER (ORDER BY pos) AS stop FROM starts)
"""

SQL = {
    "g8_symbol_agg": "SELECT sym, count(*) AS n, max(ask_px) / 10000.0::DOUBLE AS max_ask FROM quotes GROUP BY sym",
    "g8_live_symbols": "SELECT sym, count(*) AS n, min(px) AS low, max(px) AS high FROM live_quotes GROUP BY sym",
    "f1_batch_rowcount": _FEED + "SELECT batch // 8 AS segment_seq, batch % 8 AS batch, count(*) AS row_count FROM batched GROUP BY ALL",
    "g1_g2_zone_map": _FEED + "SELECT batch, row_count, ts_min, ts_max, stat_min, stat_max FROM zones",
    "f3_segment_seq": _FEED + "SELECT batch // 8 AS segment_seq, count(*) AS row_count, count(DISTINCT batch) AS batches FROM batched GROUP BY ALL",
    "f4_interval_floor": _FEED + "SELECT interval_start, interval_start + 14400000000 AS interval_end, count(*) AS n FROM cycles GROUP BY ALL",
    "f4_f3_rotation": _FEED + "SELECT interval_start, segment_seq, batch, count(*) AS row_count FROM rotated GROUP BY ALL",
    # The start of each batch follows from the one before: pointers from every row to the next start, then a chase.
    "f2_varlen_budget": _BUDGET + """
SELECT st.batch, count(*) AS row_count, min(event_id) AS first_id, CAST(sum(len) AS BIGINT) AS bytes FROM sized s JOIN spans st ON s.pos >= st.pos AND s.pos < st.stop GROUP BY st.batch""",
    "c9_varlen_store": _BUDGET + """
SELECT st.batch, count(*) AS row_count, min(event_id) AS first_id FROM sized s JOIN spans st ON s.pos >= st.pos AND s.pos < st.stop GROUP BY st.batch""",
    "f1_lazy_seal": _FEED + "SELECT batch, sealed, row_count > 0 AS sealed_finally FROM zones",
    "f8_row_by_position": _FEED + "SELECT batch // 8 AS segment_seq, event_id FROM batched WHERE batch % 8 = 3 AND pos % 256 = 17",
    "prune_time": _FEED + "SELECT batch, sealed FROM zones, span WHERE NOT sealed OR (ts_min <= hi AND ts_max >= lo)",
    "prune_stat": _FEED + "SELECT batch, sealed FROM zones WHERE NOT sealed OR (stat_min <= 140 AND stat_max >= 100)",
    "prune_both": _FEED + "SELECT batch, sealed FROM zones, span WHERE NOT sealed OR (ts_min <= hi AND ts_max >= lo AND stat_min <= 140 AND stat_max >= 100)",
    "prune_none": _FEED + "SELECT batch, sealed FROM zones",
    "prune_detached": _FEED + "SELECT id, row_count FROM ids WHERE id > (SELECT id FROM ids WHERE segment_seq = 0 ORDER BY id LIMIT 1 OFFSET 2)",
    "sql_route_detached": _FEED + """SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM feed
  WHERE ts // 86400000000 > (SELECT d FROM (SELECT DISTINCT ts // 86400000000 AS d FROM feed) ORDER BY d LIMIT 1 OFFSET 2) AND user_id >= 100 GROUP BY event_type""",
    "scan_both": _FEED + "SELECT event_id, user_id, batch, pos AS row_pos FROM batched, span WHERE ts BETWEEN lo AND hi AND user_id BETWEEN 100 AND 140",
    "b3_versions": """WITH parts AS (SELECT v AS version, count(*) AS n, CAST(max(epoch_us(ts)) AS BIGINT) AS ts_max FROM events JOIN (SELECT unnest([1, 2, 3]) AS v) ON event_id % 3 < v GROUP BY v)
SELECT version, CAST(n AS BIGINT) AS n, (n - 1) // 256 AS sealed, ts_max FROM parts""",
    "c13_empty_batches": """SELECT CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS row_count, true AS sealed, CAST(NULL AS BIGINT) AS ts_min
  UNION ALL SELECT 1, count(*), true, min(epoch_us(ts)) FROM events UNION ALL SELECT 2, 0, false, NULL""",
    # One event in ten is a trade at the bid or the ask; ids, spreads and the band hold for every row.
    "b16_feed": "SELECT CAST(10000 AS BIGINT) AS quotes, CAST(0 AS BIGINT) AS crossed, CAST(0 AS BIGINT) AS out_of_band, CAST(1000 AS BIGINT) AS trades, CAST(0 AS BIGINT) AS off_market, CAST(1000 AS BIGINT) AS ids",
    "c18_backfill": """SELECT t.tbl, CAST(d AS BIGINT) * 86400000000 AS interval_start, CAST(n AS BIGINT) AS row_count, CAST(ceil(n / 512.0) AS BIGINT) AS batches, true AS inside, CAST(1 AS BIGINT) AS epoch
  FROM (VALUES ('quotes', 2000), ('trades', 200)) t(tbl, n), range(19998, 20001) r(d)""",
    "r15_cycles": _FEED + """SELECT ts // c * c AS interval_start, ts // c * c + c AS interval_end, count(*) AS n, CAST(c // 60000000 AS INTEGER) AS cycle
  FROM feed, (SELECT unnest([30, 240, 360, 1440]) * CAST(60000000 AS BIGINT) AS c) GROUP BY ALL""",
    "r17_pinned_reader": _FEED + """SELECT 'before' AS reader, count(*) AS n, min(event_id) AS first_id FROM feed
  UNION ALL SELECT 'after', count(*), min(event_id) FROM feed WHERE ts // 86400000000 IN (SELECT d FROM (SELECT DISTINCT ts // 86400000000 AS d FROM feed) ORDER BY d DESC LIMIT 3)""",
    "s6_idle_rotation": """WITH n AS (SELECT count(*) FILTER (WHERE event_id % 2 = 0) AS even, count(*) FILTER (WHERE event_id % 2 = 1) AS odd FROM events)
SELECT CAST(0 AS INTEGER) AS moment, CAST(0 AS BIGINT) AS start_minute, even AS row_count, false AS sealed FROM n UNION ALL SELECT 1, 0, even, true FROM n UNION ALL SELECT 2, 0, even, true FROM n UNION ALL SELECT 2, 240, odd, false FROM n""",
    "c4_all_types": "SELECT ts, flag, i8, u16, i32, i64, dec38, d32, t64, sym, lower(hex(fsb)) AS fsb, lower(hex(bin)) AS bin, " + ", ".join(f"CASE WHEN isnan({c}) THEN 'nan' WHEN isinf({c}) THEN CASE WHEN {c} > 0 THEN 'inf' ELSE '-inf' END WHEN {c} IS NOT NULL THEN 'finite' END AS {c}_kind, CASE WHEN isfinite({c}) THEN {c}::DOUBLE + 0.0::DOUBLE END AS {c}" for c in ("f32", "f64")) + " FROM all_types",
    "c17_two_tables": """SELECT 'buys' AS tbl, count(*) AS n, CAST(2 AS BIGINT) AS first_epoch, CAST(2 AS BIGINT) AS last_epoch FROM trades WHERE upper(side) = 'B'
  UNION ALL SELECT 'others', count(*), 2, 2 FROM trades WHERE NOT coalesce(upper(side) = 'B', false)""",
    # Kinds and widths of the accepted types.
    "a2_types": """SELECT * FROM (VALUES ('ts', 'FIXED', 8, 'timestamp'), ('flag', 'BOOL_BITMAP', 0, 'boolean'), ('i8', 'FIXED', 1, 'tinyint'), ('u16', 'FIXED', 2, 'int'), ('i32', 'FIXED', 4, 'int'), ('i64', 'FIXED', 8, 'bigint'),
  ('f32', 'FIXED', 4, 'float'), ('f64', 'FIXED', 8, 'double'), ('dec38', 'FIXED', 16, 'decimal(38,9)'), ('d32', 'FIXED', 4, 'date'), ('t64', 'FIXED', 8, 'bigint'), ('fsb', 'FIXED', 16, 'binary'), ('sym', 'VARLEN', 0, 'string'), ('bin', 'VARLEN', 0, 'binary')) t(name, kind, width, stored)""",
    # Per column a bitmap of 125 bytes, offsets of 4 x 1,001 bytes if of variable length, and its data, each from a multiple of 64.
    "a7_layout": """WITH c AS (SELECT * FROM (VALUES (0, 'ts', 8000, false), (1, 'sym', 8000, true), (2, 'px', 8000, false), (3, 'sz', 4000, false), (4, 'side', 1000, true), (5, 'trade_id', 8000, false), (6, 'venue', 8000, true)) t(place, name, capacity, varlen)),
  b AS (SELECT *, 0 AS part, 125 AS size FROM c UNION ALL SELECT *, 1, 4004 FROM c WHERE varlen UNION ALL SELECT *, 2, capacity FROM c),
  o AS (SELECT *, coalesce(sum((size + 63) // 64 * 64) OVER (ORDER BY place, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place0 FROM b)
  SELECT place, name, CAST(max(place0) FILTER (WHERE part = 0) AS BIGINT) AS validity, CAST(max(place0) FILTER (WHERE part = 1) AS BIGINT) AS offsets, CAST(max(place0) FILTER (WHERE part = 2) AS BIGINT) AS data, CAST(max(capacity) AS BIGINT) AS capacity,
    CAST(((SELECT max(place0 + size) FROM o) + 4095) // 4096 * 4096 AS BIGINT) AS batch_bytes FROM o GROUP BY place, name""",
    "r14_cycles": """WITH t AS (SELECT unnest(['1m', '30m', '45m', '4h', '6h', '7h', '24h', '25h', '1d', '2d', '0m', '90s', '4x', 'h', '', '1440m']) AS cycle),
  m AS (SELECT cycle, TRY_CAST(regexp_extract(cycle, '^([0-9]+)[mhd]$', 1) AS INTEGER) * CASE right(cycle, 1) WHEN 'm' THEN 1 WHEN 'h' THEN 60 WHEN 'd' THEN 1440 END AS n FROM t)
  SELECT cycle, CASE WHEN n BETWEEN 1 AND 1440 AND 1440 % n = 0 THEN n END AS minutes FROM m""",
    "store_range_scan": "SELECT ts, sym, bid_px, ask_px, bid_sz, ask_sz, venue FROM quotes WHERE epoch_us(ts) >= 1452470400000000 AND epoch_us(ts) < 1452556800000000 AND bid_px BETWEEN 100000 AND 900000",
    "store_catalog": _STORE + """SELECT interval_start, CAST(pos // 131072 AS INTEGER) AS seq, pos // 8192 % 16 AS batch, count(*) AS row_count, min(t) AS ts_min, max(t) AS ts_max,
  min(bid_px) AS stat_min, max(bid_px) AS stat_max, true AS sealed FROM p GROUP BY interval_start, pos // 131072, pos // 8192 % 16""",
    "r18_encode_id": _FEED + "SELECT start_minute, segment_seq, id FROM ids",
    "r18_decode_id": _FEED + "SELECT id, id >> 31 AS start_minute, (id >> 15) & 65535 AS cycle, id & 32767 AS seq FROM ids",
    "r7_segment_name": _FEED + "SELECT name, row_count FROM named",
    "r8_parse_name": _FEED + "SELECT name, start_minute, CAST(cycle AS INTEGER) AS cycle, segment_seq AS seq FROM named",
    "r9_listing_order": _FEED + "SELECT row_number() OVER (ORDER BY start_minute, cycle, segment_seq) AS place, start_minute, segment_seq FROM segments",
    "r10_next_seq": _FEED + "SELECT start_minute, CAST(cycle AS INTEGER) AS cycle, max(segment_seq) + 1 AS next_seq FROM segments GROUP BY start_minute, cycle",
    # Days go to three writers in turn; the last one by name was written by the one whose turn its day was.
    "r11_latest_epoch": _FEED + "SELECT CAST(3 AS BIGINT) AS largest, CAST(CASE max(ts // 86400000000) % 3 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS BIGINT) AS latest FROM feed",
    "r12_interval_end": _FEED + "SELECT start_minute, segment_seq, start_minute + cycle AS end_minute, CAST(make_timestamp(start_minute * 60000000) AS DATE) AS day FROM segments",
    "r16_retention": _FEED + "SELECT start_minute, segment_seq, row_count FROM (SELECT *, row_number() OVER (ORDER BY start_minute DESC, segment_seq DESC) AS rn FROM segments) WHERE rn <= 5",
    "r19_civil_days": """SELECT days, CAST(year(d0) AS INTEGER) AS y, CAST(month(d0) AS INTEGER) AS m, CAST(day(d0) AS INTEGER) AS d, CAST(make_date(year(d0), month(d0), day(d0)) - DATE '1970-01-01' AS INTEGER) AS back, n
  FROM (SELECT CAST(epoch_us(o_orderdate) // 86400000000 AS INTEGER) AS days, DATE '1970-01-01' + CAST(epoch_us(o_orderdate) // 86400000000 AS INTEGER) AS d0, count(*) AS n FROM orders GROUP BY ALL)""",
    "g4_in_progress_rows": _FEED + "SELECT arg_max(row_count, batch) AS open_rows, count(*) AS open_batches FROM zones WHERE NOT sealed",
    "g5_g6_coverage": _FEED + "SELECT interval_start, segment_seq, count(*) AS row_count, min(ts) AS ts_min, max(ts) AS ts_max, min(ts) >= interval_start AND max(ts) < interval_start + 14400000000 AS inside FROM rotated GROUP BY interval_start, segment_seq",
    "b5_null_counts": "SELECT epoch_us(ts) // 86400000000 AS day, " + ", ".join(f"count(*) - count({c}) AS {c}_nulls" for c in "flag i8 u16 i32 i64 f32 f64 dec38 d32 t64 fsb sym bin".split()) + " FROM all_types GROUP BY ALL",
    "b15_cells": """SELECT coalesce(CAST(epoch_us(ts) AS VARCHAR), '') AS ts, coalesce(CAST(flag AS VARCHAR), '') AS flag, coalesce(CAST(i8 AS VARCHAR), '') AS i8, coalesce(CAST(u16 AS VARCHAR), '') AS u16,
  coalesce(CAST(i32 AS VARCHAR), '') AS i32, coalesce(CAST(i64 AS VARCHAR), '') AS i64, coalesce(CAST(dec38 AS VARCHAR), '') AS dec38, coalesce(CAST(d32 - DATE '1970-01-01' AS VARCHAR), '') AS d32,
  coalesce(CAST(t64 AS VARCHAR), '') AS t64, coalesce(lower(hex(fsb)), '') AS fsb, coalesce('"' || replace(sym, '"', '""') || '"', '') AS sym, coalesce(lower(hex(bin)), '') AS bin FROM all_types""",
    "b15_floats": "SELECT count(*) AS n, count(*) AS same64, count(*) AS same32 FROM all_types WHERE f64 IS NOT NULL AND f32 IS NOT NULL",
    "x1_x2_length_bits": _FEED + "SELECT batch, CASE WHEN sealed THEN row_count ELSE row_count - 9223372036854775807 - 1 END AS word, row_count AS rows, NOT sealed AS in_progress FROM zones",
    "x3_layout_bytes": "SELECT u16, count(*) AS n, CAST((u16 + 63) // 64 * 64 AS BIGINT) AS aligned, CAST((u16 + 4095) // 4096 * 4096 AS BIGINT) AS paged, CAST((u16 + 7) // 8 AS BIGINT) AS bitmap FROM all_types WHERE u16 IS NOT NULL GROUP BY u16",
    "x4_sha256": "SELECT event_id, sha256(props) AS digest FROM events",
    "x10_price": "SELECT row_id, px / 10000.0::DOUBLE AS price FROM trades",
    "x11_decimal_halves": """SELECT i64, i8, CASE WHEN abs(v) < 100000000000000000000000000000000000000::HUGEINT THEN CAST((CASE WHEN v < 0 THEN '-' ELSE '' END) || substr(d, 1, 30) || '.' || substr(d, 31) AS DECIMAL(38,9)) END AS dec
  FROM (SELECT i64, i8, v, lpad(CAST(abs(v) AS VARCHAR), 39, '0') AS d FROM (
    SELECT i64, i8, i8::HUGEINT * 18446744073709551616::HUGEINT + CASE WHEN i64 < 0 THEN i64::HUGEINT + 18446744073709551616::HUGEINT ELSE i64::HUGEINT END AS v FROM all_types WHERE i64 IS NOT NULL AND i32 IS NOT NULL AND i8 IS NOT NULL))""",
    "x12_unsigned": """SELECT i8, i32, i64, CAST(CASE WHEN i8 < 0 THEN i8::BIGINT + 256 ELSE i8 END AS BIGINT) AS u8, CAST(CASE WHEN i32 < 0 THEN i32::BIGINT + 4294967296 ELSE i32 END AS BIGINT) AS u32,
  CAST(CASE WHEN i64 < 0 THEN i64::HUGEINT + 18446744073709551616::HUGEINT ELSE i64::HUGEINT END AS DECIMAL(20,0)) AS u64 FROM all_types""",
    "x13_hex": "SELECT lower(hex(fsb)) AS fsb, lower(hex(bin)) AS bin, '\"' || replace(sym, '\"', '\"\"') || '\"' AS sym FROM all_types",
    "x14_overlap": _FEED + "SELECT batch, stat_min <= 140 AND stat_max >= 100 AS meets FROM zones",
    "s3_snapshot_freeze": "SELECT 'frozen' AS \"view\", count(*) AS n FROM live_quotes WHERE sym < 'N' UNION ALL SELECT 'now', count(*) FROM live_quotes",
    "s7_liveness": """SELECT sym, count(*) FILTER (WHERE gap >= 60000000) AS stalls, max(gap) AS longest FROM (
  SELECT sym, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sym, epoch_us(ts) // 86400000000 ORDER BY ts, quote_id) AS gap FROM quotes WHERE sym IS NOT NULL) GROUP BY sym""",
    "s7_states": """SELECT 'none' AS moment, 'NONE' AS state, CAST(0 AS BIGINT) AS open_rows, CAST(0 AS BIGINT) AS beats UNION ALL SELECT 'frozen', 'ALIVE', count(*), 1 FROM live_quotes
  UNION ALL SELECT 'late', 'STALLED', count(*), 1 FROM live_quotes UNION ALL SELECT 'stuck', 'STUCK', count(*), 2 FROM live_quotes""",
    "s11_sessions": """WITH t AS (SELECT sym, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sym ORDER BY ts) AS gap FROM trades WHERE ts IS NOT NULL AND sym IS NOT NULL),
  s AS (SELECT *, sum(CASE WHEN gap < 600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY sym ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM t)
  SELECT sym, min(t) AS session_start, max(t) + 600000000 AS session_end, count(*) AS n FROM s GROUP BY sym, k""",
    "s10_tumbling": "SELECT epoch_us(ts) // 14400000000 * 14400000000 AS window_start, venue, count(*) AS n FROM trades WHERE ts IS NOT NULL GROUP BY ALL",
    "s11_sliding": "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([epoch_us(ts) // 3600000000 * 3600000000, epoch_us(ts) // 3600000000 * 3600000000 - 3600000000]) AS w FROM trades WHERE ts IS NOT NULL) GROUP BY w",
    "s1_stream_append": "SELECT epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM live_quotes GROUP BY ALL",
    "w_asof_quote_trade": """WITH q AS (SELECT sym, ts, arg_max(quote_id, quote_id) AS quote_id, max_by(struct_pack(b := bid_px, a := ask_px), quote_id) AS s FROM quotes WHERE sym IS NOT NULL GROUP BY sym, ts)
  SELECT t.row_id, t.px, q.quote_id, q.s.b AS bid_px, q.s.a AS ask_px FROM (SELECT * FROM trades WHERE sym IS NOT NULL) t ASOF LEFT JOIN q ON t.sym = q.sym AND t.ts >= q.ts""",
    "w_ohlc_4h": """SELECT sym, epoch_us(ts) // 14400000000 * 14400000000 AS interval_start, arg_min(px, (ts, row_id)) AS open, max(px) AS high, min(px) AS low, arg_max(px, (ts, row_id)) AS close, CAST(sum(sz) AS BIGINT) AS volume
  FROM trades WHERE sym IS NOT NULL AND ts IS NOT NULL AND px IS NOT NULL GROUP BY ALL""",
    "w_vwap": """SELECT sym, CAST(sum(px::HUGEINT * sz) AS DECIMAL(38,0)) AS traded, CAST(sum(sz) AS BIGINT) AS volume, sum(px::HUGEINT * sz)::DOUBLE / sum(sz)::DOUBLE AS vwap
  FROM trades WHERE px IS NOT NULL AND sz IS NOT NULL GROUP BY sym""",
    "w_ref_dim_join": "SELECT r_name, n_name, count(*) AS customers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "a10_sorted_roll": "SELECT row_id, row_number() OVER (ORDER BY sym NULLS FIRST, ts NULLS FIRST, row_id) - 1 AS place FROM trades",
    "lineitem_zone_map": """SELECT pos // 4096 AS batch, count(*) AS row_count, min(ts) AS ts_min, max(ts) AS ts_max, min(l_partkey) AS stat_min, max(l_partkey) AS stat_max
  FROM (SELECT epoch_us(l_shipdate) AS ts, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey) - 1 AS pos FROM lineitem) GROUP BY ALL""",
}
