"""Oracle SQL: order checks, execution, positions, valuation, replay and operations."""

from __future__ import annotations

from oracle.fixtures import cte, r, with_
from oracle.prices import broken

UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
DOWN = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
CASH, BENCH, DAY = "300000.0::DOUBLE", "50.0::DOUBLE", "DATE '1998-06-29'"
FEE, SLIP = "1.0::DOUBLE", "0.0005::DOUBLE"


def position_ctes(source: str, order: str) -> dict[str, str]:
    """Average-cost positions of (portfolio, symbol) groups, up to the first oversell."""
    w = f"PARTITION BY portfolio, symbol ORDER BY {order}"
    return {
        "p1": f"""
SELECT *, sum(s) OVER ({w} {UP}) AS held FROM (
  SELECT *, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS s,
         CASE WHEN side = 'BUY' THEN -(quantity * price + fee) ELSE quantity * price - fee END AS cash FROM {source})""",
        "p2": f"SELECT *, max(CASE WHEN held < -1e-9 THEN 1 ELSE 0 END) OVER ({w} {UP}) AS broken FROM p1",
        "p3": """
SELECT *, broken = 0 AND abs(held) < 1e-9 AS flat,
       CASE WHEN broken = 0 AND side = 'SELL' AND abs(held) >= 1e-9 THEN ln(1 - quantity / (held - s)) ELSE 0.0 END AS lo FROM p2""",
        "p4": f"""
SELECT *, sum(CASE WHEN flat THEN 1 ELSE 0 END) OVER ({w} {DOWN}) AS flats, sum(lo) OVER ({w} {DOWN}) AS left_over,
       row_number() OVER ({w}) AS rn FROM p3""",
        "pos": """
SELECT portfolio, symbol, count(CASE WHEN broken = 0 THEN 1 END) AS fills,
       CASE WHEN abs(coalesce(sum(CASE WHEN broken = 0 THEN s END), 0.0)) < 1e-9 THEN 0.0
            ELSE sum(CASE WHEN broken = 0 THEN s END) END AS quantity,
       coalesce(sum(CASE WHEN broken = 0 AND side = 'BUY' AND flats = 0 THEN -cash * exp(left_over) END), 0.0) AS cost_basis,
       coalesce(sum(CASE WHEN broken = 0 THEN cash END), 0.0) AS flow,
       arg_min(CASE WHEN held < -1e-9 THEN fill_id END, CASE WHEN held < -1e-9 THEN rn END) AS oversold_by
FROM p4 GROUP BY portfolio, symbol""",
    }


FILL_ORDER = "executed_on, l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, price"
POS = f"""SELECT portfolio, symbol, fills, {r('quantity')} AS quantity, {r('cost_basis + 1e-9')} AS cost_basis,
{r('flow + cost_basis + 1e-9')} AS realized_pnl, oversold_by FROM pos"""

cte("session_fills", "SELECT *, CAST(date_trunc('week', executed_on) AS DATE) AS session FROM fills", "fills")
cte("marks", "SELECT symbol, session, open AS mark FROM bars WHERE volume % 50 <> 0", "bars")
cte("flows", """
SELECT portfolio, symbol, session, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS delta
FROM session_fills GROUP BY ALL""", "session_fills")
cte("book", f"""
SELECT *, sum(delta) OVER (PARTITION BY portfolio, symbol ORDER BY session {UP}) AS quantity FROM (
  SELECT portfolio, symbol, session, sum(delta) AS delta, max(mark) AS mark FROM (
    SELECT portfolio, symbol, session, delta, NULL::DOUBLE AS mark FROM flows
    UNION ALL SELECT o.portfolio, o.symbol, m.session, 0.0, m.mark
    FROM (SELECT portfolio, symbol, min(session) AS opened FROM flows GROUP BY ALL) o
    JOIN marks m ON m.symbol = o.symbol AND m.session >= o.opened) GROUP BY ALL)""", "flows", "marks")
cte("cash_flows", f"""
SELECT portfolio, session, flow, {CASH} + sum(flow) OVER (PARTITION BY portfolio ORDER BY session {UP}) AS cash FROM (
  SELECT portfolio, session, sum(CASE WHEN side = 'BUY' THEN -(quantity * price + fee) ELSE quantity * price - fee END) AS flow
  FROM session_fills GROUP BY ALL)""", "session_fills")
cte("valued", f"""
SELECT v.*, cash + exposure AS value, b.close AS bench FROM (
  SELECT e.portfolio, e.session, exposure, missing, coalesce(last_value(c.cash IGNORE NULLS) OVER (
           PARTITION BY e.portfolio ORDER BY e.session {UP}), {CASH}) AS cash
  FROM (SELECT portfolio, session, coalesce(sum(quantity * mark), 0.0) AS exposure,
               count(CASE WHEN abs(quantity) >= 1e-9 AND mark IS NULL THEN 1 END) AS missing FROM book GROUP BY ALL) e
  LEFT JOIN cash_flows c ON c.portfolio = e.portfolio AND c.session = e.session) v
LEFT JOIN bench b ON b.session = v.session""", "book", "cash_flows", "bench")
cte("matched", """
SELECT o.*, q.session, q.observed_at, q.mid, q.spread_bps, q.available_quantity, q.halted FROM order_rows o
ASOF LEFT JOIN quotes q ON o.symbol = q.symbol AND o.earliest_execution_at <= q.observed_at""", "order_rows", "quotes")
cte("executed", f"""
SELECT *, CASE WHEN reason IS NULL THEN least(quantity, available_quantity) END AS q,
       CASE WHEN side = 'BUY' THEN 1.0 ELSE -1.0 END AS direction, spread_bps / 20000 AS half FROM (
  SELECT *, CASE WHEN mid IS NULL THEN 'no quote' WHEN halted THEN 'instrument halted'
                 WHEN available_quantity <= 0 THEN 'no executable liquidity' END AS reason FROM matched)""", "matched")
STATUS = "CASE WHEN reason IS NOT NULL THEN 'REJECTED' WHEN q < quantity THEN 'PARTIAL' ELSE 'FILLED' END"
cte("queue_events", """
SELECT fill_id, portfolio, executed_on, l_orderkey % 37 = 0 AS wrong, epoch_days * 1000 + 100 AS sequence FROM fill_days
UNION ALL SELECT fill_id, portfolio, executed_on, l_orderkey % 37 = 0, epoch_days * 1000 + 150 FROM fill_days WHERE l_orderkey % 41 = 0""",
    "fill_days")
cte("fill_days", "SELECT *, CAST(date_diff('day', DATE '1970-01-01', executed_on) AS BIGINT) AS epoch_days FROM fills", "fills")
cte("queue_states", """
SELECT *, CASE WHEN portfolio = 'P9' OR (portfolio = 'P7' AND sequence % 1000 < 120) THEN 'NOT_FROZEN'
               WHEN wrong THEN 'WRONG_TIME' ELSE 'QUEUED' END AS state FROM queue_events""", "queue_events")
cte("accepted", "SELECT fill_id, min(sequence) AS accepted_at FROM queue_states WHERE state = 'QUEUED' GROUP BY ALL", "queue_states")
cte("result_states", """
SELECT e.*, CASE WHEN a.accepted_at IS NULL THEN 'UNQUEUED' WHEN sequence % 1000 = 250 THEN 'DUPLICATE' ELSE 'APPLIED' END AS outcome
FROM (SELECT *, epoch_days * 1000 + 200 AS sequence FROM fill_days
      UNION ALL SELECT *, epoch_days * 1000 + 250 FROM fill_days WHERE l_orderkey % 43 = 0) e
LEFT JOIN accepted a USING (fill_id)""", "fill_days", "accepted")

N = "(length(order_id) + CAST(abs(quantity) AS INTEGER))"

SQL = {
    "order_validity": with_("order_rows", f"""
SELECT order_id, violations FROM (SELECT order_id, {broken([
    ('quantity_positive', f'{N} % 31 <> 0'), ('weight_in_range', f'{N} % 17 <> 0'),
    ('executes_after_submission', f'{N} % 13 <> 0'), ('known_side', f'{N} % 29 <> 0')])} AS violations FROM order_rows)
WHERE violations <> ''"""),
    "quote_validity": with_("quotes", f"""
SELECT symbol, session, violations FROM (SELECT symbol, session, {broken([
    ('mid_positive', 'available_quantity % 41 <> 0'), ('spread_not_negative', 'available_quantity % 37 <> 0'),
    ('available_quantity_not_negative', 'available_quantity % 43 <> 0')])} AS violations FROM quotes) WHERE violations <> ''"""),
    "fill_validity": with_("executed", f"""
SELECT order_id, violations FROM (SELECT order_id, {broken([('price_positive', 'q <> 17'), ('fee_not_negative', 'q <> 13')])} AS violations
  FROM executed WHERE reason IS NULL) WHERE violations <> ''"""),
    "executability_reasons": with_("order_rows quotes", """
SELECT order_id, CASE WHEN q.symbol <> o.symbol THEN 'quote symbol mismatch' WHEN halted THEN 'instrument halted'
  WHEN observed_at < earliest_execution_at THEN 'quote unavailable for permitted execution session'
  WHEN available_quantity % 7 = 0 THEN 'no executable liquidity' ELSE 'executable' END AS reason
FROM (SELECT *, CAST(date_trunc('week', submitted_at) AS DATE) + CASE WHEN quantity % 5 = 0 THEN 0 ELSE 7 END AS quoted_on,
             CASE WHEN quantity % 11 = 0 THEN 'Brand-1' ELSE symbol END AS asked FROM order_rows) o
JOIN quotes q ON q.symbol = o.asked AND q.session = o.quoted_on"""),
    "order_quote_match": with_("matched", "SELECT order_id, session, mid, coalesce(halted, false) AS halted FROM matched"),
    "executions": with_("executed", f"""
SELECT order_id, side, {r('q')} AS quantity, CASE WHEN reason IS NULL THEN {r(f'mid * (1 + direction * (half + {SLIP}))')} END AS price,
       {r('q * mid * half')} AS spread_cost, {r(f'q * mid * {SLIP}')} AS slippage_cost, CASE WHEN reason IS NULL THEN {FEE} END AS fee,
       {r('CASE WHEN reason IS NULL THEN quantity - q ELSE quantity END')} AS residual,
       CASE WHEN reason IS NULL THEN observed_at END AS executed_at, {STATUS} AS status, reason FROM executed"""),
    "positions": with_("fills", POS, **position_ctes("fills", FILL_ORDER)),
    "account_view": with_("fills", f"""
SELECT portfolio, symbol, {r('quantity')} AS quantity, {r('cost_basis / quantity + 1e-9')} AS average_cost FROM pos WHERE quantity <> 0""",
        **position_ctes("fills", FILL_ORDER)),
    "cash_ledger": with_("fills", f"""
SELECT portfolio, {r(f'{CASH} + sum(flow)', 4)} AS cash, {r('min(balance)', 4)} AS lowest_cash,
       arg_min(CASE WHEN balance < 0 THEN fill_id END, CASE WHEN balance < 0 THEN pos END) AS overdrawn_by
FROM balances GROUP BY portfolio""", moves="""
SELECT *, CASE WHEN side = 'BUY' THEN -(quantity * price + fee) ELSE quantity * price - fee END AS flow FROM fills""",
        balances=f"SELECT *, {CASH} + sum(flow) OVER (PARTITION BY portfolio ORDER BY pos {UP}) AS balance FROM moves"),
    "valuations": with_("valued", f"""
SELECT portfolio, session, {r('value', 4)} AS portfolio_value, {r('bench', 4)} AS benchmark_value, {r('cash', 4)} AS cash,
       {r('exposure', 4)} AS gross_exposure, {r(f'value / {CASH} - 1', 9)} AS total_return, {r(f'bench / {BENCH} - 1', 9)} AS benchmark_return,
       {r(f'value / {CASH} - bench / {BENCH}', 9)} AS excess_return, missing AS missing_marks FROM valued"""),
    "missing_marks": with_("book", f"""
SELECT portfolio, symbol, session, {r('quantity')} AS quantity FROM book WHERE abs(quantity) >= 1e-9 AND mark IS NULL"""),
    "weight_limits": with_("book cash_flows order_rows", f"""
SELECT order_id, session, {r('w')} AS weight, CASE WHEN unmarked > 0 THEN 'unknown' WHEN w <= 0.02 THEN 'true' ELSE 'false' END AS within_limit, unmarked FROM (
  SELECT o.order_id, o.session, e.unmarked, CASE WHEN e.unmarked = 0 THEN (b.before + o.quantity) * b.mark / nullif(e.equity, 0) END AS w
  FROM (SELECT *, CAST(date_trunc('week', submitted_at) AS DATE) AS session FROM order_rows WHERE side = 'BUY') o
  JOIN opened b ON b.portfolio = o.portfolio AND b.symbol = o.symbol AND b.session = o.session
  JOIN equities e ON e.portfolio = o.portfolio AND e.session = o.session)""",
        opened="SELECT *, coalesce(lag(quantity) OVER (PARTITION BY portfolio, symbol ORDER BY session), 0.0) AS before FROM book",
        turns="""
SELECT portfolio, symbol, session, abs(quantity) >= 1e-9 AS is_open FROM opened WHERE (abs(quantity) >= 1e-9) <> (abs(before) >= 1e-9)""",
        spans="""
SELECT portfolio, symbol, session AS since, (SELECT min(l.session) FROM turns l WHERE l.portfolio = t.portfolio AND l.symbol = t.symbol
       AND l.session > t.session AND NOT l.is_open) AS until FROM turns t WHERE is_open""",
        equities=f"""
SELECT w.portfolio, w.session, worth + coalesce(c.cash - c.flow, {CASH}) AS equity,
       CAST((SELECT count(*) FROM spans s WHERE s.portfolio = w.portfolio AND s.since < w.session AND (s.until IS NULL OR s.until >= w.session)) - marked AS BIGINT)
         AS unmarked
FROM (SELECT portfolio, session, coalesce(sum(before * mark), 0.0) AS worth,
             count(CASE WHEN abs(before) >= 1e-9 AND mark IS NOT NULL THEN 1 END) AS marked FROM opened GROUP BY ALL) w
LEFT JOIN cash_flows c ON c.portfolio = w.portfolio AND c.session = w.session"""),
    "target_orders": with_("valued book bars", f"""
SELECT portfolio, symbol, CASE WHEN mark IS NOT NULL THEN concat_ws(':', '1998-06-29', portfolio, symbol, side) END AS order_id,
       CASE WHEN mark IS NOT NULL THEN side END AS side, {r('abs(delta)')} AS quantity, mark AS reference_price,
       CASE WHEN mark IS NULL THEN 'MISSING_MARK' ELSE 'ORDER' END AS outcome
FROM (SELECT *, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM sized)
WHERE (mark IS NULL AND abs(quantity) >= 1e-9) OR abs(delta) * mark >= 10""",
        sized=f"""
SELECT b.portfolio, b.symbol, b.quantity, m.mark, v.value * CASE WHEN
  (CAST(substr(b.portfolio, 2) AS INTEGER) + CAST(regexp_extract(b.symbol, '([0-9]+)$', 1) AS INTEGER)) % 3 = 0 THEN 0.08 ELSE 0.0 END
  / m.mark - b.quantity AS delta
FROM book b JOIN valued v ON v.portfolio = b.portfolio AND v.session = b.session
LEFT JOIN (SELECT symbol, open AS mark FROM bars WHERE session = {DAY} AND symbol <> 'Brand-9') m ON m.symbol = b.symbol
WHERE b.session = {DAY}"""),
    "portfolio_hashes": with_("fills bars", """
SELECT h.portfolio, sha256(concat_ws('|', CAST(CAST(round(cash * 10000) AS BIGINT) AS VARCHAR), hash)) AS snapshot_hash
FROM (SELECT portfolio, sha256(string_agg(line, ',' ORDER BY line)) AS hash FROM (
  SELECT portfolio, concat_ws('|', symbol, CAST(CAST(round(quantity * 1000000) AS BIGINT) AS VARCHAR),
           CAST(CAST(round((cost_basis + 1e-9) * 1000000) AS BIGINT) AS VARCHAR), CAST(CAST(round(mark * 10000) AS BIGINT) AS VARCHAR)) AS line
  FROM pos JOIN (SELECT symbol, arg_max(close, session) AS mark FROM bars GROUP BY ALL) USING (symbol)) GROUP BY ALL) h
JOIN (SELECT portfolio, 300000.0::DOUBLE + sum(CASE WHEN side = 'BUY' THEN -(quantity * price + fee) ELSE quantity * price - fee END) AS cash
      FROM fills GROUP BY ALL) c ON c.portfolio = h.portfolio""", **position_ctes("fills", FILL_ORDER)),
    "event_replay": with_("queue_states accepted result_states", """
SELECT sequence, 'PAPER_ORDER_QUEUED' AS event_type, fill_id AS order_id,
       CASE WHEN state = 'QUEUED' AND sequence > accepted_at THEN 'DUPLICATE' ELSE state END AS outcome
FROM queue_states LEFT JOIN accepted USING (fill_id)
UNION ALL SELECT sequence, 'PAPER_ORDER_RESULT', fill_id, outcome FROM result_states"""),
    "replayed_positions": with_("result_states", POS, kept="""
SELECT * FROM result_states WHERE outcome = 'APPLIED' AND l_orderkey % 29 <> 0""", **position_ctes("kept", "sequence, fill_id")),
    "transition_audit": with_("lifecycle", """
SELECT user_id, event_id, previous, state, previous IS NULL OR (previous, state) IN (('CANDIDATE', 'APPROVED'),
  ('APPROVED', 'ORDER_PENDING'), ('ORDER_PENDING', 'OPEN'), ('OPEN', 'EXIT_REQUIRED'), ('EXIT_REQUIRED', 'ORDER_PENDING')) AS legal
FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM lifecycle)"""),
    "job_status_counts": with_("job_rows", """
SELECT status, count(job_id) AS jobs FROM (SELECT unnest(['PENDING', 'RUNNING', 'SUCCEEDED', 'DEAD']) AS status)
LEFT JOIN job_rows USING (status) GROUP BY status"""),
    "operational_health": with_("job_rows", """
SELECT dead = 0 AND latest >= TIMESTAMP '2024-02-02' - INTERVAL '2' DAY AS healthy, dead, latest,
       concat_ws(',', CASE WHEN dead > 0 THEN 'dead-letter jobs require review' END,
         CASE WHEN latest < TIMESTAMP '2024-02-02' - INTERVAL '2' DAY THEN 'latest data snapshot is stale' END) AS reasons
FROM (SELECT count(CASE WHEN status = 'DEAD' THEN 1 END) AS dead,
             max(CASE WHEN status = 'SUCCEEDED' AND job_id % 100 < 50 THEN updated_at END) AS latest FROM job_rows)"""),
}
