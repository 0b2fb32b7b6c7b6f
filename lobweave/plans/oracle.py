"""The driver's queries in DuckDB SQL, written from the definitions: common table expressions shared by name."""

from __future__ import annotations

FX_TRADES = """
fx_trades AS (
  SELECT 'tpch' AS exchange, 'P' || (l_partkey % 7) AS symbol, epoch_ns(l_shipdate) AS timestamp_ns, epoch_ns(l_shipdate) + (l_orderkey % 1000) * 1000000 AS received_ns,
         year(l_shipdate) AS session,
         row_number() OVER (PARTITION BY l_partkey % 7, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS capture_seq,
         l_orderkey * 10 + l_linenumber AS trade_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
         CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS aggressor
  FROM lineitem)"""

FX_BOOK = """
fx_e AS (SELECT event_id, ts, user_id, event_type AS symbol, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
fx_t AS (SELECT *, CASE WHEN rn % 400 = 1 THEN 'snapshot' WHEN k % 4 = 3 THEN 'trade' ELSE 'book_update' END AS type FROM fx_e),
fx_s AS (SELECT *, sum(CASE WHEN type <> 'trade' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn) AS seq0 FROM fx_t),
fx_book AS (
  SELECT type, symbol, epoch_ns(ts) AS timestamp_ns, epoch_ns(ts) + 5000000 - 1000 * (event_id % 3) AS received_ns, rn, rn - 1 AS capture_seq, event_id, user_id, k,
         CASE WHEN type = 'trade' THEN NULL WHEN type = 'book_update' AND rn % 350 = 349 THEN seq0 - 5 ELSE seq0 END::BIGINT AS seq,
         CASE WHEN k % 5 = 0 THEN 0 ELSE k END AS qty,
         CASE WHEN type = 'trade' THEN CAST(100.00 + 0.01 * (k % 10) AS DECIMAL(18,2)) END AS price, CASE WHEN type = 'trade' THEN CAST(1 + k % 13 AS DECIMAL(18,2)) END AS quantity,
         CASE WHEN type = 'trade' THEN CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END END AS aggressor
  FROM fx_s WHERE NOT (type = 'book_update' AND rn % 1300 = 700)),
fx_levels AS (
  SELECT symbol, rn, type, 'bid' AS side, CAST(100.00 - 0.01 * i AS DECIMAL(18,2)) AS price, CAST(1 + (7 * i + rn) % 17 AS DECIMAL(18,2)) AS quantity FROM fx_book, range(20) r(i) WHERE type = 'snapshot'
  UNION ALL SELECT symbol, rn, type, 'ask', CAST(100.01 + 0.01 * i AS DECIMAL(18,2)), CAST(1 + (5 * i + rn) % 17 AS DECIMAL(18,2)) FROM fx_book, range(20) r(i) WHERE type = 'snapshot'
  UNION ALL SELECT symbol, rn, type, CASE WHEN k % 2 = 0 THEN 'bid' ELSE 'ask' END,
    CASE WHEN k % 2 = 0 THEN CASE WHEN rn % 900 = 450 AND qty > 0 THEN CAST(100.50 AS DECIMAL(18,2)) ELSE CAST(100.00 - 0.01 * (user_id % 20) AS DECIMAL(18,2)) END ELSE CAST(100.01 + 0.01 * (user_id % 20) AS DECIMAL(18,2)) END,
    CAST(qty AS DECIMAL(18,2)) FROM fx_book WHERE type = 'book_update')"""

BOOK = (
    FX_BOOK
    + """,
b_ep AS (SELECT *, sum(CASE WHEN type = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn) AS ep FROM fx_book),
b_seen AS (SELECT *, max(seq) OVER (PARTITION BY symbol, ep ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b_ep WHERE type <> 'trade'),
b_dup AS (SELECT *, coalesce(type = 'book_update' AND seq <= seen, false) AS dup FROM b_seen),
b_adv AS (SELECT *, coalesce(sum(CASE WHEN type = 'book_update' AND NOT dup THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, ep ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS adv FROM b_dup),
b_gap AS (SELECT *, coalesce(type = 'book_update' AND NOT dup AND CASE WHEN adv = 0 THEN seq > seen + 1 ELSE seq <> seen + 1 END, false) AS gap FROM b_adv),
b_first AS (SELECT *, min(CASE WHEN gap THEN rn END) OVER (PARTITION BY symbol, ep) AS first_gap FROM b_gap),
b_live AS (SELECT symbol, ep, rn FROM b_first WHERE ep > 0 AND NOT dup AND (first_gap IS NULL OR rn < first_gap)),
b_lev AS (SELECT l.symbol, e.ep, l.rn, l.side, l.price, l.quantity, lead(l.rn) OVER (PARTITION BY l.symbol, e.ep, l.side, l.price ORDER BY l.rn) AS until
          FROM fx_levels l JOIN b_live e ON e.symbol = l.symbol AND e.rn = l.rn),
b_top AS (SELECT e.symbol, e.rn, list(l.price ORDER BY l.price DESC) FILTER (side = 'bid') AS bp, list(l.quantity ORDER BY l.price DESC) FILTER (side = 'bid') AS bq,
                 list(l.price ORDER BY l.price) FILTER (side = 'ask') AS ap, list(l.quantity ORDER BY l.price) FILTER (side = 'ask') AS aq
          FROM b_live e LEFT JOIN b_lev l ON l.symbol = e.symbol AND l.ep = e.ep AND l.quantity > 0 AND l.rn <= e.rn AND (l.until IS NULL OR e.rn < l.until) GROUP BY e.symbol, e.rn),
b_cross AS (SELECT b.*, t.bp, t.bq, t.ap, t.aq, coalesce(t.bp[1] >= t.ap[1], false) AS crossed FROM b_first b LEFT JOIN b_top t ON t.symbol = b.symbol AND t.rn = b.rn),
b_fail AS (SELECT *, min(CASE WHEN gap OR crossed THEN rn END) OVER (PARTITION BY symbol, ep) AS fail FROM b_cross),
book AS (SELECT *, CASE WHEN type = 'snapshot' THEN CASE WHEN crossed THEN 'INVALID' ELSE 'SEEDED' END WHEN ep = 0 OR rn > fail THEN 'NOT_SYNCED' WHEN dup THEN 'DUPLICATE' WHEN gap THEN 'GAP' WHEN crossed THEN 'CROSSED' ELSE 'APPLIED' END AS result FROM b_fail)"""
)

FLOW = (
    BOOK
    + """,
o_rows AS (SELECT symbol, rn, type, timestamp_ns, NULL::DECIMAL(18,2) AS price, NULL::DECIMAL(18,2) AS quantity, NULL AS aggressor, bp, bq, ap, aq FROM book WHERE result IN ('SEEDED', 'APPLIED')
           UNION ALL SELECT symbol, rn, type, timestamp_ns, price, quantity, aggressor, NULL, NULL, NULL, NULL FROM fx_book WHERE type = 'trade'),
o_now AS (SELECT *, max(timestamp_ns) OVER w AS now, sum(CASE WHEN type = 'snapshot' THEN 1 ELSE 0 END) OVER w AS fe, max(CASE WHEN type = 'trade' THEN timestamp_ns END) OVER w AS eff,
                 coalesce(max(CASE WHEN type = 'book_update' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tracking
          FROM o_rows WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
o_trades AS (SELECT * FROM o_now WHERE type = 'trade' AND eff >= now - 21600000000000),
o_win AS (SELECT a.symbol, a.rn, sum(t.quantity) AS volume, sum(CAST(t.price AS DOUBLE) * CAST(t.quantity AS DOUBLE)) AS notional,
                 coalesce(sum(CASE WHEN t.aggressor = 'buy' THEN t.quantity END), 0) AS bought, coalesce(sum(CASE WHEN t.aggressor = 'sell' THEN t.quantity END), 0) AS sold
          FROM o_now a LEFT JOIN o_trades t ON t.symbol = a.symbol AND t.rn <= a.rn AND t.eff >= a.now - 21600000000000 WHERE a.type = 'book_update' GROUP BY a.symbol, a.rn),
o_mid AS (SELECT *, CAST(bp[1] + ap[1] AS DOUBLE) / 2 AS mid, max(CASE WHEN type = 'snapshot' AND tracking = 1 THEN now + 21600000000000 END) OVER (PARTITION BY symbol, fe) AS hole FROM o_now WHERE type <> 'trade'),
o_prev AS (SELECT *, lag(bp[1]) OVER w AS bp0, lag(bq[1]) OVER w AS bq0, lag(ap[1]) OVER w AS ap0, lag(aq[1]) OVER w AS aq0, lag(mid) OVER w AS mid0 FROM o_mid WINDOW w AS (PARTITION BY symbol, fe ORDER BY rn)),
o_flow AS (SELECT *, CASE WHEN type = 'book_update' AND bp0 IS NOT NULL AND ap0 IS NOT NULL AND bp[1] IS NOT NULL AND ap[1] IS NOT NULL THEN
                    CASE WHEN bp[1] >= bp0 THEN bq[1] ELSE 0 END - CASE WHEN bp[1] <= bp0 THEN bq0 ELSE 0 END - CASE WHEN ap[1] <= ap0 THEN aq[1] ELSE 0 END + CASE WHEN ap[1] >= ap0 THEN aq0 ELSE 0 END END AS flow,
                  CASE WHEN type = 'book_update' AND mid <> mid0 THEN ln(mid / mid0) * ln(mid / mid0) END AS square FROM o_prev),
o_sums AS (SELECT a.symbol, a.rn, coalesce(sum(b.flow), 0) AS ofi, sum(b.square) AS squares FROM o_flow a LEFT JOIN o_flow b ON b.symbol = a.symbol AND b.fe = a.fe AND b.rn <= a.rn AND b.now >= a.now - 21600000000000
           WHERE a.type = 'book_update' GROUP BY a.symbol, a.rn),
features AS (
  SELECT f.symbol, f.rn - 1 AS capture_seq, f.timestamp_ns, bp[1]::DOUBLE AS best_bid, ap[1]::DOUBLE AS best_ask, round((ap[1] - bp[1])::DOUBLE + 1e-9, 6) AS spread, round(mid + 1e-9, 6) AS midprice,
         round((bp[1]::DOUBLE * aq[1]::DOUBLE + ap[1]::DOUBLE * bq[1]::DOUBLE) / (bq[1] + aq[1])::DOUBLE + 1e-9, 6) AS microprice,
         b1 AS bid_depth_1, round((b1 - a1) / nullif(b1 + a1, 0) + 1e-9, 6) AS imbalance_1, round((b5 - a5) / nullif(b5 + a5, 0) + 1e-9, 6) AS imbalance_5, round((b10 - a10) / nullif(b10 + a10, 0) + 1e-9, 6) AS imbalance_10,
         b10 AS bid_depth_10, a10 AS ask_depth_10, round(notional / nullif(volume::DOUBLE, 0) + 1e-9, 6) AS vwap, round((bought - sold)::DOUBLE / nullif((bought + sold)::DOUBLE, 0) + 1e-9, 6) AS trade_imbalance,
         CASE WHEN f.hole IS NULL OR f.now >= f.hole THEN ofi::DOUBLE END AS order_flow_imbalance, CASE WHEN f.hole IS NULL OR f.now >= f.hole THEN round(sqrt(squares) + 1e-9, 6) END AS realised_volatility
  FROM (SELECT *, coalesce(list_sum(bq[1:1]), 0)::DOUBLE AS b1, coalesce(list_sum(aq[1:1]), 0)::DOUBLE AS a1, coalesce(list_sum(bq[1:5]), 0)::DOUBLE AS b5, coalesce(list_sum(aq[1:5]), 0)::DOUBLE AS a5,
               coalesce(list_sum(bq[1:10]), 0)::DOUBLE AS b10, coalesce(list_sum(aq[1:10]), 0)::DOUBLE AS a10 FROM o_flow WHERE type = 'book_update') f
  JOIN o_win w ON w.symbol = f.symbol AND w.rn = f.rn JOIN o_sums s ON s.symbol = f.symbol AND s.rn = f.rn)"""
)

TRADE_WINDOW = (
    FX_TRADES
    + """,
t_ord AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session, capture_seq) AS ord FROM fx_trades),
t_now AS (SELECT *, max(timestamp_ns) OVER (PARTITION BY symbol ORDER BY ord) AS now FROM t_ord),
t_day AS (SELECT symbol, now, ord, sum(quantity) OVER d AS v, sum(CAST(price AS DOUBLE) * CAST(quantity AS DOUBLE)) OVER d AS n, sum(CASE WHEN aggressor = 'buy' THEN quantity ELSE 0 END) OVER d AS b FROM t_now WINDOW d AS (PARTITION BY symbol, now ORDER BY ord)),
t_old AS (SELECT symbol, now, max(v) AS v, max(n) AS n, max(b) AS b FROM t_day GROUP BY symbol, now),
t_before AS (SELECT symbol, now, coalesce(sum(v) OVER p, 0) AS v, coalesce(sum(n) OVER p, 0) AS n, coalesce(sum(b) OVER p, 0) AS b FROM t_old
             WINDOW p AS (PARTITION BY symbol ORDER BY now RANGE BETWEEN 2592000000000000 PRECEDING AND 1 PRECEDING)),
t_win AS (SELECT t.symbol, t.session, t.capture_seq, t.now, d.v + p.v AS volume, d.n + p.n AS notional, d.b + p.b AS bought FROM t_now t JOIN t_day d ON d.symbol = t.symbol AND d.ord = t.ord JOIN t_before p ON p.symbol = t.symbol AND p.now = t.now)"""
)


def _q(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


FEATURE_LIST = "best_bid, best_ask, spread, midprice, microprice, imbalance_1, imbalance_5, imbalance_10, bid_depth_10, ask_depth_10, vwap, trade_imbalance, order_flow_imbalance, realised_volatility"

SQL = {
    "trades_by_aggressor": _q(FX_TRADES, "SELECT aggressor, count(*) AS trades, sum(quantity)::DOUBLE AS quantity FROM fx_trades GROUP BY aggressor"),
    "trades_ordered_page": _q(
        FX_TRADES,
        """, r AS (SELECT *, row_number() OVER (ORDER BY session, capture_seq) AS n FROM fx_trades WHERE symbol = 'P3' AND (session > 1993 OR (session = 1993 AND capture_seq > 20)))
        SELECT session, capture_seq, trade_id, price::DOUBLE AS price FROM r WHERE n <= 500 AND (n - 1) * 200 < 60000""",
    ),
    "trades_time_range": _q(FX_TRADES, "SELECT symbol, session, capture_seq, timestamp_ns, price::DOUBLE AS price FROM fx_trades WHERE timestamp_ns BETWEEN 788918400000000000 AND 804556800000000000 AND capture_seq >= 10"),
    "catalogue_sessions": _q(
        FX_TRADES,
        """SELECT symbol, session, 'trades' AS stream, count(*) AS rows, min(capture_seq) AS first_seq, max(capture_seq) AS last_seq, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns,
           (sum(count(*)) OVER (PARTITION BY symbol, session))::BIGINT AS events FROM fx_trades GROUP BY symbol, session""",
    ),
    "capture_seq_assign": _q(FX_BOOK, "SELECT symbol, event_id, row_number() OVER (PARTITION BY symbol ORDER BY event_id) - 1 AS capture_seq FROM fx_book"),
    "partition_date": "SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) AS trades FROM lineitem GROUP BY 1",
    "replay_order_union": _q(FX_BOOK, "SELECT symbol, type, 1::BIGINT AS session, capture_seq, row_number() OVER (PARTITION BY symbol ORDER BY capture_seq) AS ord FROM fx_book"),
    "replay_pacing_offsets": _q(
        FX_BOOK,
        """, d AS (SELECT symbol, capture_seq, greatest(0, coalesce(received_ns - lag(received_ns) OVER (PARTITION BY symbol ORDER BY capture_seq), 0)) AS w FROM fx_book)
        SELECT symbol, capture_seq, round(sum(w) OVER (PARTITION BY symbol ORDER BY capture_seq) / 1e9 / 100 + 1e-9, 6) AS emit_offset_s FROM d""",
    ),
    "levels_long_form": _q(FX_BOOK, "SELECT symbol, rn - 1 AS capture_seq, side, price::DOUBLE AS price, quantity::DOUBLE AS quantity FROM fx_levels WHERE type = 'book_update' OR quantity > 0"),
    "sequence_gaps": _q(FX_BOOK, """, g AS (SELECT symbol, seq AS first_seq, seq - lag(seq) OVER (PARTITION BY symbol ORDER BY seq) - 1 AS gap FROM fx_book WHERE type = 'book_update') SELECT symbol, first_seq, gap FROM g WHERE gap <> 0"""),
    "sequence_span": _q(FX_BOOK, "SELECT symbol, max(seq) - min(seq) AS span FROM fx_book WHERE type = 'book_update' GROUP BY symbol"),
    "null_counts": _q(FX_BOOK, """SELECT * FROM (SELECT 'first_seq' AS "column", count(*) FILTER (type <> 'book_update') AS nulls FROM fx_book UNION ALL SELECT 'last_seq', count(*) FILTER (seq IS NULL) FROM fx_book
        UNION ALL SELECT 'trade_id', count(*) FILTER (type <> 'trade') FROM fx_book UNION ALL SELECT 'price', count(*) FILTER (price IS NULL) FROM fx_book UNION ALL SELECT 'quantity', count(*) FILTER (quantity IS NULL) FROM fx_book
        UNION ALL SELECT 'aggressor', count(*) FILTER (aggressor IS NULL) FROM fx_book UNION ALL SELECT 'bids', count(*) FILTER (type = 'trade') FROM fx_book UNION ALL SELECT 'asks', count(*) FILTER (type = 'trade') FROM fx_book)"""),
    "session_from_filename": _q(FX_TRADES, "SELECT session, 1 AS files, count(*) AS trades, min(capture_seq) AS first_seq, max(capture_seq) AS last_seq FROM fx_trades GROUP BY session"),
    "latest_ring": _q(FX_BOOK, "SELECT symbol, n - 1 AS n, trade_id, timestamp_ns, aggressor FROM (SELECT symbol, event_id AS trade_id, timestamp_ns, aggressor, row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) AS n FROM fx_book WHERE type = 'trade') WHERE n <= 100"),
    "book_event_json": _q(
        FX_BOOK,
        """
SELECT symbol, capture_seq, 200 + 60 * coalesce(n, 0) AS size,
       '{"type":"' || type || '","session":1,"exchange":"tpch","symbol":"' || symbol || '","timestamp_ns":' || timestamp_ns || ',"received_ns":' || received_ns || ',"last_seq":' || seq
       || CASE WHEN type = 'book_update' THEN ',"first_seq":' || seq ELSE '' END || ',"bids":[' || coalesce(bids, '') || '],"asks":[' || coalesce(asks, '') || ']}' AS body
FROM fx_book LEFT JOIN (
  SELECT symbol, rn, count(*) AS n, string_agg(x, ',' ORDER BY price DESC) FILTER (side = 'bid') AS bids, string_agg(x, ',' ORDER BY price) FILTER (side = 'ask') AS asks
  FROM (SELECT *, '{"price":"' || CAST(price AS DECIMAL(38,18)) || '","quantity":"' || CAST(quantity AS DECIMAL(38,18)) || '"}' AS x FROM fx_levels) GROUP BY symbol, rn) l USING (symbol, rn)
WHERE type <> 'trade'""",
    ),
    "seeded_feed": _q(
        FX_BOOK
        + """,
s_gap AS (SELECT *, coalesce(type = 'book_update' AND seq > max(seq) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, false) AS gap FROM fx_book),
s_try AS (SELECT *, sum(gap::BIGINT) OVER (PARTITION BY symbol ORDER BY rn) AS attempt FROM s_gap),
s_seed AS (SELECT symbol, attempt, min(s.rn) AS seed FROM s_try s JOIN (SELECT symbol, attempt, coalesce(min(seq) FILTER (type = 'book_update'), 0) AS lo FROM s_try GROUP BY ALL) USING (symbol, attempt) WHERE type = 'snapshot' AND seq + 1 >= lo GROUP BY symbol, attempt),
s_at AS (SELECT t.*, seed, (SELECT x.seq FROM fx_book x WHERE x.symbol = t.symbol AND x.rn = seed) AS base FROM s_try t JOIN s_seed USING (symbol, attempt)),
s_rank AS (SELECT *, CASE WHEN rn = seed THEN 0 WHEN rn < seed AND type = 'snapshot' THEN NULL WHEN rn < seed AND type = 'trade' THEN 1 WHEN type = 'book_update' AND seq <= base THEN NULL WHEN rn < seed THEN 2 ELSE 3 END AS r FROM s_at)""",
        """
SELECT symbol, attempt::BIGINT AS attempt, row_number() OVER (PARTITION BY symbol ORDER BY attempt, r, rn) - 1 AS capture_seq, type, timestamp_ns, seq AS last_seq, CASE WHEN type = 'trade' THEN event_id END AS trade_id
FROM s_rank WHERE r IS NOT NULL""",
    ),
    "latest_trades": _q(FX_BOOK, "SELECT symbol, trade_id, price::DOUBLE AS price, quantity::DOUBLE AS quantity, aggressor, n FROM (SELECT symbol, event_id AS trade_id, price, quantity, aggressor, row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) AS n FROM fx_book WHERE type = 'trade') WHERE n <= 50"),
    "stale_gaps": _q(FX_BOOK, "SELECT * FROM (SELECT symbol, capture_seq, received_ns - lag(received_ns) OVER (PARTITION BY symbol ORDER BY capture_seq) AS silence_ns FROM fx_book) WHERE silence_ns > 1800000000000"),
    "snapshot_join": _q(
        FX_BOOK,
        """, s AS (SELECT symbol, seq AS snapshot_seq FROM fx_book WHERE type = 'snapshot' AND rn = 401), u AS (SELECT b.symbol, b.rn, b.seq, s.snapshot_seq FROM fx_book b JOIN s USING (symbol) WHERE type = 'book_update' AND seq > snapshot_seq)
        SELECT symbol, rn - 1 AS capture_seq, seq AS first_seq, first_value(seq) OVER (PARTITION BY symbol ORDER BY rn) > snapshot_seq + 1 AS too_old FROM u""",
    ),
    "latency_percentiles": _q(
        FX_TRADES,
        """, s AS (SELECT symbol, list(price ORDER BY price) AS p FROM fx_trades GROUP BY symbol)
        SELECT symbol, len(p) AS count, p[least(len(p) - 1, floor(len(p) * 0.5::DOUBLE)::BIGINT) + 1]::DOUBLE AS p50, p[least(len(p) - 1, floor(len(p) * 0.95::DOUBLE)::BIGINT) + 1]::DOUBLE AS p95, p[least(len(p) - 1, floor(len(p) * 0.99::DOUBLE)::BIGINT) + 1]::DOUBLE AS p99, p[-1]::DOUBLE AS worst FROM s""",
    ),
    "book_apply_result": _q(BOOK, "SELECT symbol, rn - 1 AS capture_seq, type, result FROM book"),
    "book_result_counts": _q(
        BOOK,
        """SELECT f.symbol, count(*) AS events, count(*) FILTER (f.type = 'trade') AS trades, count(*) FILTER (f.type = 'snapshot') AS snapshots, count(*) FILTER (b.result = 'APPLIED') AS applied,
           count(*) FILTER (b.result IN ('DUPLICATE', 'GAP', 'CROSSED', 'NOT_SYNCED')) AS rejected FROM fx_book f LEFT JOIN book b ON b.symbol = f.symbol AND b.rn = f.rn GROUP BY f.symbol""",
    ),
    "book_touch": _q(BOOK, "SELECT symbol, rn - 1 AS capture_seq, bp[1]::DOUBLE AS best_bid, bq[1]::DOUBLE AS bid_quantity, ap[1]::DOUBLE AS best_ask, aq[1]::DOUBLE AS ask_quantity FROM book WHERE result IN ('SEEDED', 'APPLIED')"),
    "book_top_levels": _q(
        BOOK,
        """, v AS (SELECT * FROM book WHERE result IN ('SEEDED', 'APPLIED')), l AS (SELECT symbol, rn, 'bid' AS side, unnest(range(1, least(len(bp), 5) + 1)) AS pos, unnest(bp[1:5]) AS price, unnest(bq[1:5]) AS quantity FROM v
        UNION ALL SELECT symbol, rn, 'ask', unnest(range(1, least(len(ap), 5) + 1)), unnest(ap[1:5]), unnest(aq[1:5]) FROM v) SELECT symbol, rn - 1 AS capture_seq, side, pos, price::DOUBLE AS price, quantity::DOUBLE AS quantity FROM l""",
    ),
    "book_as_of": _q(
        BOOK,
        """, m AS (SELECT symbol, unnest([250, 777, 1500]) AS at FROM (SELECT DISTINCT symbol FROM fx_book)), r AS (SELECT m.symbol, m.at, max(b.rn) AS rn FROM m JOIN book b ON b.symbol = m.symbol AND b.rn - 1 <= m.at GROUP BY ALL)
        SELECT r.symbol, r.at, b.result, b.seq AS last_seq, bp[1]::DOUBLE AS best_bid, ap[1]::DOUBLE AS best_ask FROM r JOIN book b ON b.symbol = r.symbol AND b.rn = r.rn WHERE b.result IN ('SEEDED', 'APPLIED')""",
    ),
    "book_spread_mid_micro": _q(FLOW, "SELECT symbol, capture_seq, spread, midprice, microprice FROM features"),
    "book_depth_imbalance": _q(FLOW, "SELECT symbol, capture_seq, bid_depth_10, ask_depth_10, imbalance_1, imbalance_5, imbalance_10 FROM features"),
    "flow_clock": _q(FX_TRADES, "SELECT symbol, session, capture_seq, max(timestamp_ns) OVER (PARTITION BY symbol ORDER BY session, capture_seq) AS now FROM fx_trades"),
    "flow_vwap": _q(TRADE_WINDOW, "SELECT symbol, session, capture_seq, volume::DOUBLE AS volume, round(notional / volume::DOUBLE + 1e-9, 6) AS vwap FROM t_win"),
    "flow_trade_imbalance": _q(TRADE_WINDOW, "SELECT symbol, session, capture_seq, round((2 * bought - volume)::DOUBLE / volume::DOUBLE + 1e-9, 6) AS trade_imbalance FROM t_win"),
    "flow_ofi": _q(FLOW, "SELECT symbol, capture_seq, order_flow_imbalance FROM features"),
    "flow_realised_vol": _q(FLOW, "SELECT symbol, capture_seq, realised_volatility FROM features"),
    "feature_snapshot": _q(FLOW, f"SELECT symbol, capture_seq, timestamp_ns, {FEATURE_LIST} FROM features"),
    "latest_state": _q(
        BOOK,
        """, l AS (SELECT symbol, arg_max(result, rn) FILTER (result <> 'DUPLICATE') AS result, arg_max(seq, rn) FILTER (result IN ('SEEDED', 'APPLIED', 'CROSSED')) AS last_seq FROM book GROUP BY symbol),
        t AS (SELECT symbol, count(*) AS events, count(*) FILTER (type = 'snapshot') AS snapshots, arg_max(event_id, rn) FILTER (type = 'trade') AS last_trade_id FROM fx_book GROUP BY symbol)
        SELECT symbol, events, snapshots, CASE result WHEN 'SEEDED' THEN 'SEEDED' WHEN 'APPLIED' THEN 'SYNCED' ELSE 'INVALID' END AS state, last_seq, last_trade_id, result = 'APPLIED' AS has_features FROM t JOIN l USING (symbol)""",
    ),
    "parse_frames": _q(
        FX_BOOK,
        """SELECT symbol, type, capture_seq, timestamp_ns // 1000000 * 1000000 AS timestamp_ns, CASE WHEN type = 'trade' THEN NULL ELSE seq END AS first_seq, CASE WHEN type = 'trade' THEN event_id END AS trade_id, price::DOUBLE AS price, aggressor,
           CASE WHEN type = 'book_update' THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END AS n_bids FROM fx_book WHERE type <> 'snapshot'""",
    ),
    "parse_snapshot": _q(FX_BOOK, "SELECT upper(symbol) AS symbol, capture_seq, received_ns AS timestamp_ns, seq AS last_seq, 20 AS n_bids, 20 AS n_asks, 100.00::DOUBLE AS best_bid FROM fx_book WHERE type = 'snapshot'"),
    "event_json": _q(
        FX_TRADES,
        """SELECT trade_id, capture_seq, session, symbol, '{"type":"trade","session":' || session || ',"exchange":"tpch","symbol":"' || symbol || '","timestamp_ns":' || timestamp_ns || ',"received_ns":' || received_ns || ',"trade_id":' || trade_id
           || ',"price":"' || price::VARCHAR || '0000000000000000","quantity":"' || quantity::VARCHAR || '0000000000000000","aggressor":"' || aggressor || '"}' AS body FROM fx_trades""",
    ),
    "export_merged": _q(FX_BOOK, "SELECT 1::BIGINT AS session, symbol, capture_seq, event_id AS trade_id, price::DOUBLE AS price FROM fx_book WHERE type = 'trade'"),
    "contiguity_check": _q(BOOK, "SELECT symbol, rn - 1 AS capture_seq, CASE WHEN gap THEN 'expected ' || (seen + 1) || ', got ' || seq END AS message FROM b_gap WHERE type = 'book_update'"),
}
SQL["stream_equals_batch"] = SQL["feature_snapshot"]
