"""Oracle SQL: the batch results that the streaming jobs must reproduce."""

from __future__ import annotations

from oracle.fixtures import r, with_
from oracle.ledger import SQL as LEDGER
from oracle.prices import BAR_RULES, broken

SQL = {
    "stream_bar_ingest": with_("bars", f"""
SELECT symbol, session, close, {broken(BAR_RULES)} AS violations FROM faulty""", faulty="""
SELECT symbol, session, open, high, close, volume, available_to_strategy_at,
       CASE WHEN volume % 17 = 0 THEN high + 1 ELSE low END AS low, CASE WHEN volume % 19 = 0 THEN -0.5 ELSE dividend END AS dividend,
       CASE WHEN volume % 23 = 0 THEN 0.0 ELSE split_coefficient END AS split_coefficient,
       CASE WHEN volume % 29 = 0 THEN CAST(session + 60 AS TIMESTAMP) ELSE closed_at END AS published_at FROM bars"""),
    "stream_event_log": with_("event_log", """
SELECT event_id, sha256(payload) AS payload_hash, 'STORED' AS outcome FROM event_log WHERE delivery = 0
UNION ALL SELECT event_id, CASE WHEN n % 3 = 0 THEN sha256('{"k": -1}') ELSE sha256(payload) END, 'CLASH'
FROM event_rows WHERE n % 40 = 0"""),
    "stream_session_completeness": with_("bars", """
SELECT session, CAST(count(CASE WHEN present THEN 1 END) AS INTEGER) AS seen,
       coalesce(string_agg(CASE WHEN NOT present THEN symbol END, ',' ORDER BY symbol), '') AS missing
FROM (SELECT s.session, u.symbol, b.symbol IS NOT NULL AS present
      FROM (SELECT DISTINCT session, closed_at FROM kept) s, (SELECT DISTINCT symbol FROM kept UNION ALL SELECT 'Brand-99') u
      LEFT JOIN kept b ON b.session = s.session AND b.symbol = u.symbol
      WHERE CAST(CAST(s.closed_at AS DATE) + 1 AS TIMESTAMP) <= (SELECT max(closed_at) FROM kept) - INTERVAL '14' DAY)
GROUP BY session""", kept="SELECT * FROM bars"),
    "stream_lifecycle_monitor": LEDGER["transition_audit"],
    "stream_running_positions": LEDGER["positions"],
    "stream_fill_conflicts": with_("fills", f"""
SELECT fill_id, {r('price + 1')} AS price FROM fills WHERE executed_on >= DATE '1998-07-01' AND l_orderkey % 50 = 0"""),
    "stream_status_counters": with_("job_rows", """
SELECT date_trunc('day', updated_at) AS window_start, status, count(*) AS jobs FROM job_rows GROUP BY ALL"""),
}
