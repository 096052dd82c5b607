"""Common table expressions for the oracle SQL, resolved by dependency."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql.strip())


def with_(names: str, body: str, **extra: str) -> str:
    """WITH clause holding the named CTEs and what they need, then ``extra`` CTEs, then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in ordered]
    parts += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def r(expression: str, places: int = 6) -> str:
    return f"(round({expression}, {places}) + 0.0)"


def safe(top: str, bottom: str) -> str:
    return (f"(CASE WHEN ({bottom}) IS NOT NULL AND abs({bottom}) > 1e-15 AND ({top}) IS NOT NULL "
            f"THEN ({top}) / ({bottom}) ELSE 0.0 END)")


cte("trades", """
SELECT replace(p_brand, '#', '-') AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS session,
       round(50 + l_extendedprice / l_quantity / 1000, 2) AS px, l_quantity AS qty, l_extendedprice AS amount,
       CAST(l_shipdate AS DATE) AS ship_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax, l_returnflag
FROM lineitem JOIN part ON p_partkey = l_partkey""")
cte("ranked_trades", """
SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY ship_date, l_orderkey, l_linenumber, px) AS rn,
       count(*) OVER (PARTITION BY symbol, session) AS n FROM trades""", "trades")
cte("bars", """
SELECT symbol, session, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
       max(CASE WHEN rn = n THEN px END) AS close, CAST(sum(qty) AS BIGINT) AS volume,
       CASE WHEN month(session) IN (3,6,9,12) AND day(session) <= 7 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS dividend,
       CASE WHEN session IN (DATE '1997-01-06', DATE '1999-01-04') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS split_coefficient,
       CASE WHEN max(n) < 2 THEN 'STALE' ELSE 'PASS' END AS quality,
       CAST(session AS TIMESTAMP) + INTERVAL '4' DAY + INTERVAL '21' HOUR AS closed_at,
       CAST(session AS TIMESTAMP) + INTERVAL '4' DAY + INTERVAL '21' HOUR
         + (CASE WHEN max(n) % 13 = 0 THEN INTERVAL '10' DAY ELSE INTERVAL '0' DAY END) AS available_to_strategy_at
FROM ranked_trades GROUP BY symbol, session""", "ranked_trades")
cte("bench", """
SELECT session, round(sum(round(open * 100)) * 100 / count(*)) / 10000 AS open,
       round(sum(round(close * 100)) * 100 / count(*)) / 10000 AS close,
       CAST(session AS TIMESTAMP) + INTERVAL '4' DAY + INTERVAL '21' HOUR AS available_to_strategy_at
FROM bars GROUP BY session""", "bars")
cte("market_caps", """
SELECT symbol, last_day(ship_date) AS observed_date, round(sum(amount), 2) AS market_cap,
       CAST(last_day(ship_date) AS TIMESTAMP) + INTERVAL '21' HOUR AS available_to_strategy_at
FROM trades GROUP BY ALL""", "trades")
cte("quarter_rank", """
SELECT symbol, quarter, row_number() OVER (PARTITION BY quarter ORDER BY volume DESC, symbol) AS rank
FROM (SELECT symbol, CAST(date_trunc('quarter', session) AS DATE) AS quarter, sum(volume) AS volume
      FROM bars GROUP BY ALL)""", "bars")
cte("members", """
SELECT CAST(quarter + INTERVAL '3' MONTH AS DATE) AS date, symbol FROM quarter_rank WHERE rank <= 20""", "quarter_rank")
cte("member_dates", "SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM members)",
    "members")
cte("member_spans", "SELECT symbol, date, next_date FROM members JOIN member_dates USING (date)", "member_dates")
cte("calendar", """
SELECT session, CAST(session AS TIMESTAMP) + INTERVAL '14' HOUR + INTERVAL '30' MINUTE AS open_at,
       CAST(session AS TIMESTAMP) + INTERVAL '4' DAY + INTERVAL '21' HOUR AS close_at
FROM (SELECT DISTINCT session FROM bars)""", "bars")
cte("fills", """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fill_id,
       'P' || (o_custkey % 50) AS portfolio, symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
       qty AS quantity, px AS price, l_tax AS fee, ship_date AS executed_on, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       row_number() OVER (PARTITION BY o_custkey % 50
         ORDER BY ship_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, px) AS pos
FROM trades JOIN orders ON o_orderkey = l_orderkey""", "trades")
cte("quotes", """
SELECT symbol, session, CAST(session AS TIMESTAMP) + INTERVAL '14' HOUR + INTERVAL '30' MINUTE AS observed_at,
       open AS mid, 10.0::DOUBLE AS spread_bps, volume::DOUBLE AS available_quantity, quality = 'STALE' AS halted FROM bars""",
    "bars")
cte("order_rows", """
SELECT fill_id AS order_id, portfolio, symbol, side, quantity, CAST(executed_on AS TIMESTAMP) AS submitted_at,
       CAST(executed_on + 1 AS TIMESTAMP) AS earliest_execution_at, price AS reference_price, 0.5 AS max_position_weight
FROM fills""", "fills")
cte("evidence0", """
SELECT doc_id, 'doc:' || doc_id AS id, 'Brand-' || (1 + doc_id % 25) AS symbol, text AS claim, source,
       CAST(DATE '2001-01-01' + CAST(doc_id % 400 AS INTEGER) AS TIMESTAMP) AS published_at,
       CASE WHEN lq = 0 THEN 'STALE' ELSE 'PASS' END AS quality
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS lq FROM labels GROUP BY doc_id) USING (doc_id)""")
cte("evidence", """
SELECT id, symbol, claim, source, published_at, published_at AS available_to_strategy_at, quality FROM evidence0
UNION ALL
SELECT id || ':b', symbol, ' ' || chr(9) || claim || ' ' || chr(9) || ' ', source, published_at, published_at, quality
FROM evidence0 WHERE doc_id % 10 = 0""", "evidence0")
cte("findings", r"""
SELECT conv_id // 4 AS case_id, conv_id AS report_id, turn,
       CASE conv_id % 4 WHEN 0 THEN 'BUSINESS_CHANGE' WHEN 1 THEN 'CATALYST_EVENT' WHEN 2 THEN 'FAILURE_MODE'
            ELSE 'PORTFOLIO_CONTEXT' END AS role,
       lower(role) || '-' || (turn % 3) AS topic, text AS factual_claim,
       CASE length(text) % 3 WHEN 0 THEN 'SUPPORT' WHEN 1 THEN 'CONCERN' ELSE 'NEUTRAL' END AS stance,
       CASE (length(text) // 3) % 8 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       'e' || (turn % 5) AS citation
FROM conversations""".replace("lower(role)", "lower(conversations.role)"))
cte("cases", """
SELECT case_id, 'Brand-' || (1 + case_id % 25) AS symbol,
       CAST(DATE '2001-06-01' + CAST(case_id % 90 AS INTEGER) AS TIMESTAMP) AS decision_at
FROM (SELECT DISTINCT conv_id // 4 AS case_id FROM conversations)""")
cte("reports", """
SELECT case_id, report_id, role,
       CASE WHEN report_id % 11 = 10 THEN 'OTHER' ELSE 'Brand-' || (1 + case_id % 25) END AS symbol,
       CASE WHEN report_id % 17 = 3 THEN 'DATA_GAP' END AS blocker,
       CASE WHEN report_id % 23 = 22 THEN '' ELSE 'p1' END AS prompt_version
FROM (SELECT DISTINCT case_id, report_id, role FROM findings)""", "findings")
cte("case_evidence", """
SELECT case_id, 'e' || k AS id, symbol, 's' || (k % (1 + case_id % 3)) AS source
FROM cases, range(0, 4) AS g(k) WHERE k = 0 OR case_id % 7 <> 6""", "cases")
cte("event_rows", """
SELECT 'ev:' || event_id AS event_id, event_id AS n, ts AS occurred_at, event_type,
       CAST(user_id AS VARCHAR) AS entity_id, props AS payload FROM events""")
cte("event_log", """
SELECT *, 0 AS delivery FROM event_rows UNION ALL
SELECT event_id, n, occurred_at, event_type, entity_id,
       CASE WHEN n % 40 = 0 THEN '{"k": -1}' ELSE payload END, 1 FROM event_rows WHERE n % 20 = 0""", "event_rows")
cte("lifecycle", """
SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'CANDIDATE' WHEN 'click' THEN 'APPROVED'
  WHEN 'signup' THEN 'ORDER_PENDING' WHEN 'purchase' THEN 'OPEN' ELSE 'EXIT_REQUIRED' END AS state FROM events""")
cte("job_rows", """
SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'DEAD' WHEN 'purchase' THEN 'SUCCEEDED'
  WHEN 'click' THEN 'RUNNING' ELSE 'PENDING' END AS status, ts AS updated_at FROM events""")
