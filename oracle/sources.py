"""Oracle SQL: payload parsing, stored ranges, snapshot hashes and the event log."""

from __future__ import annotations

from oracle.curves import HITS, METRICS, point_metrics
from oracle.fixtures import cte, r, with_

N = "CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS INTEGER)"
CLOSE = "CAST(session AS TIMESTAMP) + INTERVAL '21' HOUR"


def prices(kept: str, **columns: str) -> str:
    named = {n: n for n in ("open", "high", "low", "close", "adjusted_close", "dividend", "split_coefficient", "volume")}
    named.update(columns)
    listed = ", ".join(f"{v} AS {k}" for k, v in named.items() if k not in ("source", "vintage"))
    return with_("bars", f"""
SELECT upper(symbol) AS symbol, session, {listed}, '{columns['source']}' AS source, {CLOSE} AS available_to_strategy_at,
       '{columns['vintage']}retrieved:2002-01-01T00:00:00' AS vintage, 'PASS' AS quality FROM bars WHERE {kept}""")


def scaled(column: str) -> str:
    return f"CAST(CAST(round({column} * 100000000) AS BIGINT) AS VARCHAR)"


cte("bar_texts", f"""
SELECT symbol, session, concat_ws('|', symbol, CAST(session AS VARCHAR), {', '.join(scaled(c) for c in ('open', 'high', 'low', 'close'))},
       CAST(volume AS VARCHAR), {scaled('dividend')}, {scaled('split_coefficient')},
       strftime(available_to_strategy_at, '%Y-%m-%d %H:%M:%S'), quality) AS t FROM bars""", "bars")
cte("symbol_digests", """
SELECT symbol, sha256(string_agg(line, ',' ORDER BY line)) AS digest, count(*) AS rows
FROM (SELECT symbol, CAST(session AS VARCHAR) || ':' || sha256(t) AS line FROM bar_texts) GROUP BY symbol""", "bar_texts")
cte("stored_log", "SELECT event_id, sha256(payload) AS stored_hash FROM event_log WHERE delivery = 0 AND n % 3 > 0", "event_log")
cte("reduced_log", """
SELECT event_id, arg_min(n, delivery) AS n, arg_min(occurred_at, delivery) AS occurred_at, arg_min(event_type, delivery) AS event_type,
       arg_min(entity_id, delivery) AS entity_id, arg_min(payload, delivery) AS payload, count(DISTINCT payload) > 1 AS contradicts
FROM event_log GROUP BY event_id""", "event_log")

cte("placed_bars", f"SELECT *, {N} AS n, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS place FROM bars", "bars")
cte("placed_caps", """
SELECT *, month(observed_date) AS m, row_number() OVER (PARTITION BY symbol ORDER BY observed_date) - 1 AS place FROM market_caps""", "market_caps")
cte("placed_years", f"""
SELECT symbol, y, {N} AS n, row_number() OVER (PARTITION BY symbol ORDER BY y) - 1 AS place FROM (SELECT DISTINCT symbol, year(session) AS y FROM bars)""", "bars")

SQL = {
    "stored_reports": point_metrics(*METRICS, *HITS),
    "list_price_payloads": prices(f"{N} % 6 NOT IN (1, 2, 3)", adjusted_close="close",
                                  volume="CASE WHEN volume % 6 > 0 THEN volume ELSE 0 END", source="Tiingo", vintage="raw:"),
    "map_price_payloads_adjusted": prices(f"{N} % 7 NOT IN (1, 2, 3, 4)", adjusted_close="close / 2", source="Alpha Vantage", vintage=""),
    "map_price_payloads_raw": prices(f"{N} % 7 NOT IN (1, 2, 3, 4)", adjusted_close="close", dividend="0.0::DOUBLE",
                                     split_coefficient="1.0::DOUBLE", source="Alpha Vantage", vintage="raw:"),
    "quarantined_payloads": with_("bars", f"""
SELECT lower(symbol) AS symbol, 'list' AS form, CASE {N} % 6 WHEN 1 THEN 'not found' WHEN 2 THEN 'slow down' ELSE '{{"other": 1}}' END AS reason
FROM s WHERE {N} % 6 IN (1, 2, 3)
UNION ALL SELECT lower(symbol), 'map', CASE {N} % 7 WHEN 1 THEN 'rate limit' WHEN 2 THEN 'bad symbol' WHEN 3 THEN 'key'
  ELSE 'daily series missing' END FROM s WHERE {N} % 7 IN (1, 2, 3, 4)""", s="SELECT DISTINCT symbol FROM bars"),
    "market_cap_payloads": with_("market_caps", f"""
SELECT upper(symbol) AS symbol, observed_date, available_to_strategy_at, {r('market_cap', 2)} AS market_cap,
       'Tiingo Fundamentals' AS source, 'retrieved:2002-01-01T00:00:00' AS vintage FROM market_caps WHERE month(observed_date) <> 4"""),
    "ticker_map": with_("bars", f"SELECT DISTINCT upper(symbol) AS symbol, CAST({N} * 1000 + 7 AS BIGINT) AS cik FROM bars"),
    "universe_snapshot": with_("bars", """
SELECT make_date(y, 12, 31) AS as_of, CAST(CASE WHEN y % 4 = 0 THEN s + 1 WHEN y % 3 = 0 THEN s + 1 ELSE s END AS INTEGER) AS count,
       CAST(s + CASE WHEN y % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS listed, y % 3 <> 0 AND y % 4 <> 0 AS valid
FROM (SELECT year(session) AS y, count(DISTINCT symbol) AS s FROM bars GROUP BY ALL)"""),
    "covering_ranges": with_("bars", """
SELECT q.symbol, q.start, q.stop AS "end", best.a AS cached_start, best.b AS cached_end, best IS NOT NULL AS covered
FROM (SELECT r.symbol, r.start, r.stop, min(CASE WHEN c.a <= r.start AND c.b >= r.stop THEN {'w': c.b - c.a, 'a': c.a, 'b': c.b} END) AS best
      FROM requests r LEFT JOIN cached c ON c.symbol = r.symbol GROUP BY ALL) q""",
        span="SELECT symbol, year(session) AS y, min(session) AS a, max(session) AS b FROM bars GROUP BY ALL",
        cached="SELECT symbol, a, b FROM span UNION ALL SELECT symbol, min(a), max(b) FROM span GROUP BY symbol, y < 1998",
        requests="SELECT symbol, a + 30 AS start, a + CASE WHEN y % 2 = 0 THEN 200 ELSE 400 END AS stop FROM span"),
    "stored_range_read": with_("bars", """
SELECT symbol, session, close, volume FROM bars WHERE session BETWEEN DATE '1996-03-01' AND DATE '1997-06-30'"""),
    "snapshot_symbol_hashes": with_("symbol_digests", "SELECT * FROM symbol_digests"),
    "snapshot_root_hash": with_("symbol_digests", """
SELECT sha256(string_agg(symbol || ':' || digest, ',' ORDER BY symbol || ':' || digest)) AS digest, CAST(sum(rows) AS BIGINT) AS rows
FROM symbol_digests"""),
    "event_outcomes": with_("reduced_log stored_log", """
SELECT event_id, payload, sha256(payload) AS payload_hash, contradicts,
       CASE WHEN stored_hash IS NULL THEN 'NEW' WHEN stored_hash = sha256(payload) THEN 'SAME' ELSE 'CONFLICT' END AS outcome
FROM reduced_log LEFT JOIN stored_log USING (event_id)"""),
    "appended_events": with_("reduced_log stored_log", """
SELECT row_number() OVER (ORDER BY occurred_at, event_id) AS sequence, event_id, occurred_at, event_type, entity_id, payload,
       sha256(payload) AS payload_hash FROM reduced_log ANTI JOIN stored_log USING (event_id)"""),
    "entity_events": with_("reduced_log", """
SELECT sequence, event_id, event_type, sha256(payload) AS payload_hash FROM (
  SELECT *, row_number() OVER (ORDER BY occurred_at, event_id) AS sequence FROM reduced_log) WHERE entity_id = '42'"""),
    "rejected_fields": with_("placed_bars placed_caps placed_years", """
SELECT 'list' AS form, upper(symbol) AS symbol, CAST(place AS VARCHAR) AS place, 'session' AS field, '2001-13-45' AS value, 'not a date' AS reason
FROM placed_bars WHERE volume % 31 = 0
UNION ALL SELECT 'list', upper(symbol), CAST(place AS VARCHAR), 'close', '1O1', 'not a number' FROM placed_bars WHERE volume % 37 = 0
UNION ALL SELECT 'list', upper(symbol), CAST(place AS VARCHAR), 'volume', 'n/a', 'not a whole number' FROM placed_bars WHERE volume % 41 = 0
UNION ALL SELECT 'map', upper(symbol), session || 'x', 'session', session || 'x', 'not a date' FROM placed_bars WHERE volume % 43 = 0
UNION ALL SELECT 'map', upper(symbol), session || CASE WHEN volume % 43 = 0 THEN 'x' ELSE '' END, 'close', '', 'missing' FROM placed_bars WHERE volume % 47 = 0
UNION ALL SELECT 'caps', upper(symbol), CAST(place AS VARCHAR), 'observed_date', 'n/a', 'not a date' FROM placed_caps WHERE m = 5
UNION ALL SELECT 'caps', upper(symbol), CAST(place AS VARCHAR), 'market_cap', '12b', 'not a number' FROM placed_caps WHERE m = 6
UNION ALL SELECT 'facts', upper(symbol), 'Assets/USD/' || place, 'filed', y || '-02-30', 'not a date' FROM placed_years WHERE y % 2 = 0
UNION ALL SELECT DISTINCT 'tickers', upper(symbol), CAST(n AS VARCHAR), 'cik', 'x' || n, 'not a whole number' FROM placed_years WHERE n % 5 = 0
UNION ALL SELECT DISTINCT 'universe', NULL, 'definition', 'as_of', y || '-13-45', 'not a date' FROM placed_years WHERE y % 2 = 0
UNION ALL SELECT 'universe', NULL, 'definition', 'count', 'many', 'not a whole number' FROM (SELECT DISTINCT y FROM placed_years) WHERE y % 3 = 0"""),
    "accepted_items": with_("placed_bars placed_caps placed_years", """
SELECT 'list' AS form, upper(symbol) AS symbol, count(*) AS items FROM placed_bars WHERE volume % 31 <> 0 AND volume % 37 <> 0 AND volume % 41 <> 0 GROUP BY ALL
UNION ALL SELECT 'map', upper(symbol), count(*) FROM placed_bars WHERE volume % 43 <> 0 AND volume % 47 <> 0 GROUP BY ALL
UNION ALL SELECT 'caps', upper(symbol), count(*) FROM placed_caps WHERE m NOT IN (5, 6) GROUP BY ALL
UNION ALL SELECT 'facts', upper(symbol), count(*) FROM placed_years WHERE y % 2 = 1 GROUP BY ALL
UNION ALL SELECT 'tickers', upper(symbol), 1 FROM placed_years WHERE n % 5 <> 0 GROUP BY ALL
UNION ALL SELECT 'universe', NULL, count(*) FROM (SELECT DISTINCT y FROM placed_years) WHERE y % 2 = 1 AND y % 3 <> 0 HAVING count(*) > 0"""),
    "quarantined_responses": with_("bars", f"""
SELECT symbol, form, CASE {N} % 4 WHEN 2 THEN 'not valid JSON' WHEN 3 THEN 'no response'
       ELSE CASE form WHEN 'caps' THEN 'no plan' WHEN 'facts' THEN 'facts missing' ELSE 'as_of missing' END END AS reason
FROM (SELECT DISTINCT symbol FROM bars), (VALUES ('caps'), ('facts'), ('universe')) f(form) WHERE {N} % 4 > 0"""),
    "continued_event_log": with_("event_log reduced_log", """
SELECT row_number() OVER (ORDER BY event_id NOT IN (SELECT event_id FROM known), occurred_at, event_id) AS sequence, event_id, sha256(payload) AS payload_hash
FROM (SELECT event_id, occurred_at, payload FROM known
      UNION ALL SELECT event_id, occurred_at, payload FROM reduced_log WHERE event_id NOT IN (SELECT event_id FROM known))""",
        known="SELECT event_id, occurred_at, payload FROM event_log WHERE delivery = 0 AND n % 3 > 0"),
    "frozen_snapshot": with_("bars", """
SELECT symbol, session, close, true AS frozen_once FROM bars WHERE available_to_strategy_at <= TIMESTAMP '1997-12-31 23:59:59'"""),
}
