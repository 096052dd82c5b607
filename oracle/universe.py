"""Oracle SQL: point-in-time membership, as-of joins and coverage."""

from __future__ import annotations

from oracle.curves import C, CURVE, LOOKBACKS, W, curve_ctes, ranked_cte, schedule_cte, targets_cte
from oracle.fixtures import cte, r, with_

START, END = "DATE '1997-02-10'", "DATE '1998-11-16'"
FIRST = "(SELECT min(date) FROM members)"

cte("filings0", """
SELECT symbol, concept, n, end_on, end_on + CAST(20 + 5 * n AS INTEGER) AS filed, volume * (n + 1) AS val, 'USD' AS unit,
       CASE WHEN month(end_on) = 12 THEN '10-K' WHEN volume % 10 = 0 THEN '8-K' ELSE '10-Q' END AS form
FROM (SELECT symbol, last_day(CAST(date_trunc('quarter', session) + INTERVAL '2' MONTH AS DATE)) AS end_on,
             CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ALL),
     (VALUES ('Revenues', 0), ('NetIncomeLoss', 1), ('Assets', 2), ('Liabilities', 3), ('Goodwill', 4)) AS k(concept, n)""",
    "bars")
cte("filings", """
SELECT symbol, concept, unit, filed, CAST(end_on AS VARCHAR) AS end_text, CAST(val AS VARCHAR) AS val, form FROM filings0
UNION ALL SELECT symbol, concept, 'EUR', filed + 40, CAST(end_on AS VARCHAR), val || '1', form FROM filings0 WHERE val % 7 = 0""",
    "filings0")
cte("facts", "SELECT * FROM filings WHERE concept <> 'Goodwill' AND form IN ('10-Q', '10-K')", "filings")
MEMBERS_ON = "SELECT session AS as_of, (SELECT max(date) FROM members WHERE date <= session) AS record FROM bench"
MEMBER_SESSIONS = """
SELECT d.as_of AS session, m.symbol FROM (SELECT session AS as_of, (SELECT max(date) FROM members WHERE date <= session) AS record
  FROM bench) d JOIN members m ON m.date = d.record"""
NEEDED = f"""
SELECT symbol FROM members WHERE date BETWEEN {START} AND {END}
UNION SELECT symbol FROM members WHERE date = (SELECT max(date) FROM members WHERE date <= {START})"""

SQL = {
    "membership_history": with_("members", "SELECT date, symbol FROM members"),
    "membership_spans": with_("member_spans", "SELECT symbol, date AS valid_from, next_date AS valid_to FROM member_spans"),
    "members_on_date": with_("members bench", """
SELECT as_of, record, symbol FROM dates LEFT JOIN members ON date = record""", dates=MEMBERS_ON),
    "fresh_market_caps": with_("bars market_caps", f"""
SELECT symbol, session, CASE WHEN asked_at - seen <= INTERVAL '10' DAY THEN observed_date END AS observed_date,
       CASE WHEN asked_at - seen <= INTERVAL '10' DAY THEN {r('market_cap', 2)} END AS market_cap
FROM (SELECT a.*, c.observed_date, c.market_cap, c.available_to_strategy_at AS seen
      FROM asked a ASOF LEFT JOIN market_caps c ON a.symbol = c.symbol AND a.asked_at >= c.available_to_strategy_at)""", asked="""
SELECT symbol, session, CAST(session AS TIMESTAMP) + INTERVAL '12' HOUR AS asked_at FROM bars"""),
    "top_market_cap": with_("members market_caps bars", f"""
SELECT as_of, symbol, {r('market_cap', 2)} AS market_cap, rank, fresh >= 10 AS complete FROM (
  SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY market_cap DESC, symbol) AS rank, count(*) OVER (PARTITION BY as_of) AS fresh
  FROM (SELECT e.as_of, e.symbol, arg_max(c.market_cap, c.available_to_strategy_at) AS market_cap
        FROM eligible e JOIN market_caps c ON c.symbol = e.symbol AND c.available_to_strategy_at <= e.decided_at
         AND e.decided_at - c.available_to_strategy_at <= INTERVAL '10' DAY GROUP BY ALL))
WHERE rank <= 10""", decisions="""
SELECT as_of, CAST(as_of AS TIMESTAMP) + INTERVAL '3' DAY + INTERVAL '9' HOUR AS decided_at
FROM (SELECT DISTINCT CAST(date_trunc('month', session) AS DATE) AS as_of FROM bars)""", eligible="""
SELECT as_of, decided_at, symbol FROM (
  SELECT *, (SELECT max(date) FROM members WHERE date <= as_of) AS record FROM decisions) JOIN members ON date = record"""),
    "company_facts": with_("facts", 'SELECT symbol, concept, unit, filed, end_text AS "end", val, form FROM facts'),
    "filing_evidence": with_("facts bars", """
SELECT concat_ws(':', 'sec', symbol, CAST(decision_on AS VARCHAR)) AS id, symbol,
       string_agg(concept || '=' || val || ' (' || form || ', period ended ' || end_text || ')', '; ' ORDER BY place) AS claim,
       CAST(max(filed) AS TIMESTAMP) + INTERVAL '12' HOUR AS available_to_strategy_at, 'retrieved:2002-01-01T00:00:00' AS vintage
FROM newest WHERE n = 1 GROUP BY symbol, decision_on""", decisions="""
SELECT symbol, CAST(unnest(generate_series(DATE '1995-03-01', DATE '2000-12-01', INTERVAL '2' MONTH)) AS DATE) AS decision_on
FROM (SELECT DISTINCT symbol FROM bars)""", newest="""
SELECT d.symbol, d.decision_on, f.*, list_position(['Revenues', 'RevenueFromContractWithCustomerExcludingAssessedTax',
         'NetIncomeLoss', 'OperatingIncomeLoss', 'Assets', 'Liabilities', 'CashAndCashEquivalentsAtCarryingValue'], concept) AS place,
       row_number() OVER (PARTITION BY d.symbol, d.decision_on, concept ORDER BY filed DESC, end_text DESC, val DESC, form DESC) AS n
FROM decisions d JOIN (SELECT symbol AS s, * EXCLUDE (symbol) FROM facts) f ON f.s = d.symbol AND f.filed <= d.decision_on"""),
    "latest_closed_session": with_("calendar", """
SELECT o_orderkey, session AS latest_session, next_session, next_open_at
FROM asked LEFT JOIN spans ON asked_at >= close_at AND asked_at < next_close_at""",
        asked="SELECT o_orderkey, o_orderdate + INTERVAL '22' HOUR AS asked_at FROM orders", spans="""
SELECT session, close_at, lead(close_at) OVER (ORDER BY session) AS next_close_at, lead(session) OVER (ORDER BY session) AS next_session,
       lead(open_at) OVER (ORDER BY session) AS next_open_at FROM calendar"""),
    "coverage_audit": with_("members bench", f"""
SELECT count(*) AS eligible, count(b.symbol) AS covered, {r('count(b.symbol) / count(*)')} AS coverage, count(*) = count(b.symbol) AS approved
FROM ({MEMBER_SESSIONS}) e LEFT JOIN bars b ON b.session = e.session AND b.symbol = e.symbol"""),
    "missing_prices": with_("members bench", f"""
SELECT e.session, e.symbol FROM ({MEMBER_SESSIONS}) e ANTI JOIN bars b ON b.session = e.session AND b.symbol = e.symbol"""),
    "snapshot_completeness": with_("bars calendar", """
SELECT request_id, count(symbol) AS symbols,
       CASE WHEN count(symbol) = 0 THEN 'EMPTY_UNIVERSE' WHEN bool_or(run_at < decision_at) THEN 'BEFORE_CUTOFF'
            WHEN count(symbol) > count(CASE WHEN ok THEN 1 END) THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status,
       coalesce(string_agg(CASE WHEN NOT ok THEN symbol END, ',' ORDER BY symbol), '') AS missing
FROM (SELECT r.*, s.symbol, coalesce(b.available_to_strategy_at <= r.decision_at, false) AS ok
      FROM requests r LEFT JOIN symbols s ON NOT r.hollow LEFT JOIN bars b ON b.symbol = s.symbol AND b.session = r.session)
GROUP BY request_id""", symbols="SELECT DISTINCT symbol FROM bars", requests="""
SELECT 'u:' || CAST(session AS VARCHAR) AS request_id, session, close_at AS decision_at, day(session) = 20 AS hollow,
       CASE WHEN day(session) = 13 THEN open_at ELSE close_at END AS run_at FROM calendar"""),
    "history_edges": with_("bars", f"""
SELECT symbol, first_session, last_session, CASE WHEN first_session IS NULL THEN 'not downloaded'
  WHEN first_session > {START} + 10 OR last_session < {END} - 10
  THEN 'incomplete coverage ' || CAST(first_session AS VARCHAR) || '..' || CAST(last_session AS VARCHAR) END AS reason
FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN (
  SELECT symbol, min(session) AS first_session, max(session) AS last_session FROM bars
  WHERE session BETWEEN {START} AND {END} AND NOT (symbol = 'Brand-9' AND session > DATE '1998-06-01') AND symbol <> 'Brand-11'
  GROUP BY symbol) USING (symbol)"""),
    "dynamic_membership_curve": with_("members common bench", CURVE,
        pit_sessions=f"SELECT session FROM common WHERE session >= {FIRST}",
        pit_schedule=schedule_cte("pit_sessions"),
        pit_panel="SELECT b.* FROM bars b JOIN pit_sessions USING (session)",
        bar_growth=f"""
SELECT *, product(factor) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS growth FROM (
  SELECT *, coalesce(split_coefficient * (close + dividend) / lag(close) OVER ({W}), 1.0) AS factor FROM bars)""",
        bar_momentum="SELECT symbol, session, " + ", ".join(
            f"round(growth / lag(growth, {k}) OVER ({W}), 12) - 1 AS momentum_{k}" for k in LOOKBACKS) + " FROM bar_growth",
        decisions="""
SELECT m.*, m.session AS decision FROM bar_momentum m JOIN (
  SELECT session, (SELECT max(date) FROM members WHERE date <= session) AS record FROM pit_schedule WHERE decides) s USING (session)
JOIN members e ON e.date = s.record AND e.symbol = m.symbol""",
        ranked=ranked_cte(), targets=targets_cte(), **curve_ctes(C, "pit_panel", "pit_schedule")),
    "required_symbols": with_("members", NEEDED),
    "download_worklist": with_("members bars", f"""
SELECT symbol FROM ({NEEDED}) ANTI JOIN (SELECT symbol FROM bars WHERE volume % 90 = 0) USING (symbol)"""),
    "worklist_counts": with_("members bars", f"""
SELECT count(*) AS required, count(c.symbol) AS cached, count(*) - count(c.symbol) AS remaining
FROM ({NEEDED}) n LEFT JOIN (SELECT DISTINCT symbol FROM bars WHERE volume % 90 = 0) c ON c.symbol = n.symbol"""),
    "set_comparisons": """
WITH t AS (SELECT conv_id, turn, lower(role) || '-' || (turn % 3) AS topic FROM conversations)
SELECT conv_id, string_agg(topic, ',' ORDER BY first) AS first_mentions,
       string_agg(topic, ',' ORDER BY topic) = 'assistant-1,user-0' AS equals,
       count(CASE WHEN topic NOT IN ('user-0', 'assistant-1') THEN 1 END) = 0 AS subset
FROM (SELECT conv_id, topic, min(turn) AS first FROM t GROUP BY ALL) GROUP BY conv_id""",
}
