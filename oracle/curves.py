"""Oracle SQL: signals, curves, metrics, strategy selection and comparison."""

from __future__ import annotations

from oracle.fixtures import cte, r, safe, with_

W = "PARTITION BY symbol ORDER BY session"
UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
LOOKBACKS, EVERY, TOP, START = (5, 10, 21), 8, 5, "DATE '1996-06-03'"
C = 0.0005
METRICS = (
    "total_return", "annualized_return", "benchmark_total_return", "excess_return", "volatility", "sharpe", "sortino",
    "max_drawdown", "calmar", "tracking_error", "information_ratio", "alpha", "beta", "value_at_risk_95",
    "expected_shortfall_95", "daily_benchmark_win_rate", "upside_capture", "downside_capture", "trading_costs",
    "decision_dates")
HITS = ("positive_21_session_rate", "benchmark_win_21_session_rate", "evaluated_21_session_periods",
        "positive_21_session_periods", "benchmark_wins_21_session_periods")

cte("aligned_rows", f"""
SELECT b.symbol, session, b.open, b.close, b.dividend, b.split_coefficient, k.open AS bench_open, k.close AS bench_close,
       row_number() OVER (PARTITION BY b.symbol ORDER BY session) - 1 AS i,
       coalesce(b.split_coefficient * (b.close + b.dividend) / lag(b.close) OVER (PARTITION BY b.symbol ORDER BY session), 1.0) AS factor
FROM bars b JOIN bench k USING (session)""", "bars", "bench")
cte("grown", f"SELECT *, product(factor) OVER ({W} {UP}) AS growth FROM aligned_rows", "aligned_rows")
cte("signals", " UNION ALL ".join(
    ["SELECT *, 'buy_and_hold' AS candidate, 1.0::DOUBLE AS signal FROM grown",
     "SELECT *, 'cash', 0.0::DOUBLE FROM grown"] + [
        f"SELECT *, 'momentum_{k}', CASE WHEN round(growth / lag(growth, {k}) OVER ({W}), 12) > 1 THEN 1.0 ELSE 0.0 END FROM grown"
        for k in LOOKBACKS]), "grown")
SC = "PARTITION BY symbol, candidate ORDER BY session"
cte("moves", f"""
SELECT *, coalesce(lag(signal) OVER ({SC}), 0.0) AS b, coalesce(lag(signal, 2) OVER ({SC}), 0.0) AS a,
       lag(close) OVER ({SC}) AS p FROM signals""", "signals")
cte("day_factors", f"""
SELECT *, CASE WHEN a = 1 AND b = 1 THEN split_coefficient * (1 + dividend * (1 - {C}) / open) * close / p
               WHEN a = 1 AND b = 0 THEN split_coefficient * (dividend + open * (1 - {C})) / p
               WHEN a = 0 AND b = 1 THEN (1 - {C}) * close / open ELSE 1.0 END AS f,
          CASE WHEN a = 1 AND b = 1 THEN split_coefficient * dividend * {C} / p
               WHEN a = 1 AND b = 0 THEN split_coefficient * open * {C} / p
               WHEN a = 0 AND b = 1 THEN {C} ELSE 0.0 END AS rate FROM moves""", "moves")
cte("points", f"""
SELECT symbol, candidate, session, i, b AS target, product(f) OVER ({SC} {UP}) AS equity,
       bench_close / first_value(bench_open) OVER ({SC} {UP}) AS benchmark_equity,
       rate * product(f) OVER ({SC} {UP}) / f AS cost FROM day_factors""", "day_factors")


def metrics_ctes(source: str, keys: str, tag: str, h: int = 21) -> dict[str, str]:
    k = f"PARTITION BY {keys} ORDER BY session"
    root = "sqrt(252)"
    daily = f"""
SELECT *, g - bg AS act, row_number() OVER (PARTITION BY {keys} ORDER BY g ASC NULLS LAST) AS worst,
       greatest(1, ceil((n - 1) * 0.05)) AS tail FROM (
  SELECT {keys}, session, equity, benchmark_equity, cost, row_number() OVER ({k}) - 1 AS j,
         equity / lag(equity) OVER ({k}) - 1 AS g, benchmark_equity / lag(benchmark_equity) OVER ({k}) - 1 AS bg,
         equity / max(equity) OVER ({k} {UP}) - 1 AS dd,
         coalesce(lead(equity, {h}) OVER ({k}), last_value(equity) OVER ({k} {ALL})) AS e_end,
         coalesce(lead(benchmark_equity, {h}) OVER ({k}), last_value(benchmark_equity) OVER ({k} {ALL})) AS b_end,
         count(*) OVER (PARTITION BY {keys}) AS n FROM {source})"""
    start = f"j % {h} = 0 AND j < n - 1"
    won = "round(e_end / equity - 1, 12)"
    base = f"""
SELECT {keys}, arg_min(equity, session) AS e0, arg_max(equity, session) AS e1, arg_min(benchmark_equity, session) AS b0,
       arg_max(benchmark_equity, session) AS b1, date_diff('day', min(session), max(session)) AS days,
       coalesce(avg(g), 0.0) AS m, CASE WHEN coalesce(stddev_samp(g), 0.0) > 1e-15 THEN stddev_samp(g) ELSE 0.0 END AS sd,
       coalesce(avg(bg), 0.0) AS bm, coalesce(avg(round(act, 12)), 0.0) AS am,
       CASE WHEN coalesce(stddev_samp(round(act, 12)), 0.0) > 1e-15 THEN stddev_samp(round(act, 12)) ELSE 0.0 END AS asd,
       coalesce(sqrt(avg(least(g, 0.0) * least(g, 0.0))), 0.0) AS down, least(0.0, min(dd)) AS max_drawdown,
       CASE WHEN count(g) >= 2 AND var_pop(bg) > 1e-30 THEN regr_slope(g, bg) ELSE 0.0 END AS beta,
       coalesce(-max(CASE WHEN worst <= tail THEN g END), 0.0) AS value_at_risk_95,
       coalesce(-avg(CASE WHEN worst <= tail THEN g END), 0.0) AS expected_shortfall_95,
       coalesce(avg(CASE WHEN round(act, 12) > 0 THEN 1.0 WHEN act IS NOT NULL THEN 0.0 END), 0.0) AS daily_benchmark_win_rate,
       {safe("avg(CASE WHEN bg > 0 THEN g END)", "avg(CASE WHEN bg > 0 THEN bg END)")} AS upside_capture,
       {safe("avg(CASE WHEN bg < 0 THEN g END)", "avg(CASE WHEN bg < 0 THEN bg END)")} AS downside_capture,
       sum(cost) AS trading_costs, (count(*) - 1)::DOUBLE AS decision_dates,
       count(CASE WHEN {start} THEN 1 END)::DOUBLE AS evaluated_{h}_session_periods,
       count(CASE WHEN {start} AND {won} > 0 THEN 1 END)::DOUBLE AS positive_{h}_session_periods,
       count(CASE WHEN {start} AND {won} > round(b_end / benchmark_equity - 1, 12) THEN 1 END)::DOUBLE
         AS benchmark_wins_{h}_session_periods
FROM daily_{tag} GROUP BY {keys}"""
    named = f"""
SELECT *, e1 / e0 - 1 AS total_return, pow(e1 / e0, 1 / greatest(days / 365.25, 1.0 / 252)) - 1 AS annualized_return,
       b1 / b0 - 1 AS benchmark_total_return, e1 / e0 - b1 / b0 AS excess_return, sd * {root} AS volatility,
       {safe('m', 'sd')} * {root} AS sharpe, {safe('m * 252', f'down * {root}')} AS sortino, asd * {root} AS tracking_error,
       {safe('am', 'asd')} * {root} AS information_ratio, (m - beta * bm) * 252 AS alpha,
       {safe(f'positive_{h}_session_periods', f'evaluated_{h}_session_periods')} AS positive_{h}_session_rate,
       {safe(f'benchmark_wins_{h}_session_periods', f'evaluated_{h}_session_periods')} AS benchmark_win_{h}_session_rate,
       {safe('pow(e1 / e0, 1 / greatest(days / 365.25, 1.0 / 252)) - 1', 'abs(max_drawdown)')} AS calmar
FROM base_{tag}"""
    return {f"daily_{tag}": daily, f"base_{tag}": base, f"metrics_{tag}": named}


def metric_select(source: str, keys: str, names=METRICS + HITS) -> str:
    return f"SELECT {keys}, " + ", ".join(f"{r(n)} AS {n}" for n in names) + f" FROM {source}"


def stages_cte(source: str, keys: str, warmup: int, minimum: tuple[int, int]) -> str:
    n = f"(n - {warmup})"
    return f"""
SELECT unnest(['development', 'validation', 'holdout']) AS stage, unnest([{warmup}, de - 1, ve - 1]) AS start_i,
       unnest([de, ve, n]) AS end_i
FROM (SELECT n, de, greatest(de + {minimum[1]}, {warmup} + floor({n} * 0.8)) AS ve FROM (
  SELECT n, {warmup} + greatest({minimum[0]}, floor({n} * 0.6)) AS de FROM (
    SELECT min(n) AS n FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys}))))"""


COMPARED = {
    "compared": "SELECT * FROM points WHERE candidate <> 'cash'",
    "stage_rows": stages_cte("compared", "symbol, candidate", 0, (30, 15)),
    "staged": "SELECT p.*, stage FROM compared p JOIN stage_rows ON i >= start_i AND i < end_i",
    **metrics_ctes("staged", "symbol, candidate, stage", "s"),
    "means": """
SELECT candidate, stage, avg(information_ratio) AS mean_information_ratio, avg(excess_return) AS mean_excess_return,
       avg(sharpe) AS mean_sharpe, min(max_drawdown) AS worst_drawdown, min(decision_dates) AS decision_dates
FROM metrics_s GROUP BY candidate, stage""",
    "chosen": """
SELECT candidate AS selected FROM means WHERE stage = 'development'
ORDER BY round(mean_information_ratio, 12) DESC, round(mean_excess_return, 12) DESC, candidate DESC LIMIT 1""",
}
MEANS = ("mean_information_ratio", "mean_excess_return", "mean_sharpe", "worst_drawdown", "decision_dates")
GATES = [
    ("development_excess_positive", "development", "mean_excess_return > 0"),
    ("validation_excess_positive", "validation", "mean_excess_return > 0"),
    ("validation_information_ratio_positive", "validation", "mean_information_ratio > 0"),
    ("holdout_excess_positive", "holdout", "mean_excess_return > 0"),
    ("holdout_information_ratio_positive", "holdout", "mean_information_ratio > 0"),
    ("minimum_validation_dates", "validation", "decision_dates >= 60"),
    ("minimum_holdout_dates", "holdout", "decision_dates >= 60"),
    ("validation_drawdown_within_limit", "validation", "worst_drawdown >= -0.25"),
    ("holdout_drawdown_within_limit", "holdout", "worst_drawdown >= -0.25"),
    ("survivorship_safe_universe", "holdout", "false"),
]
GATE_ROWS = " UNION ALL ".join(
    f"SELECT candidate, '{name}' AS \"check\", {ok} AS passed FROM means WHERE stage = '{stage}'" for name, stage, ok in GATES)

cte("common", """
SELECT session FROM bars GROUP BY session HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)""", "bars")
cte("panel", "SELECT b.* FROM bars b JOIN common USING (session)", "common")


def schedule_cte(source: str, every: int = EVERY) -> str:
    return f"""
SELECT session, next_session, i, i % {every} = 0 AS decides, CASE WHEN i % {every} = 0 THEN i // {every} END AS decision_period,
       CASE WHEN i >= 1 THEN (i - 1) // {every} END AS period, i >= 1 AND (i - 1) % {every} = 0 AS executes
FROM (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i, lead(session) OVER (ORDER BY session) AS next_session
      FROM {source})"""


cte("schedule", schedule_cte("common"), "common")
cte("panel_growth", f"""
SELECT *, product(factor) OVER ({W} {UP}) AS growth FROM (
  SELECT *, coalesce(split_coefficient * (close + dividend) / lag(close) OVER ({W}), 1.0) AS factor FROM panel)""", "panel")
cte("panel_momentum", "SELECT symbol, session, " + ", ".join(
    f"round(growth / lag(growth, {k}) OVER ({W}), 12) - 1 AS momentum_{k}" for k in LOOKBACKS) + " FROM panel_growth",
    "panel_growth")


def decisions_cte(schedule: str = "schedule") -> str:
    return f"SELECT m.*, session AS decision FROM panel_momentum m JOIN {schedule} USING (session) WHERE decides"


def ranked_cte(decisions: str = "decisions") -> str:
    rows = " UNION ALL ".join(
        f"SELECT 'ranked_momentum_{k}d_top{TOP}' AS strategy, decision, symbol, momentum_{k} AS momentum FROM {decisions}"
        for k in LOOKBACKS)
    return f"""
SELECT *, 1.0 / count(*) OVER (PARTITION BY strategy, decision) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY strategy, decision ORDER BY momentum DESC, symbol) AS position
  FROM ({rows}) WHERE momentum > 0) WHERE position <= {TOP}"""


def targets_cte(decisions: str = "decisions", ranked: str = "ranked") -> str:
    return f"""
SELECT 'equal_weight' AS strategy, decision, symbol, 1.0 / count(*) OVER (PARTITION BY decision) AS weight FROM {decisions}
UNION ALL SELECT strategy, decision, symbol, weight FROM {ranked}"""


NAMES = ["equal_weight"] + [f"ranked_momentum_{k}d_top{TOP}" for k in LOOKBACKS]


def curve_ctes(cost: float, panel: str = "panel", schedule: str = "schedule", names=NAMES) -> dict[str, str]:
    """Closed-form rebalanced curve from {targets}, mirroring the period decomposition."""
    sp = "PARTITION BY symbol, period ORDER BY session"
    listed = ", ".join(f"'{n}'" for n in names)
    return {
        "slots": f"""
SELECT symbol, session, period, false AS exit, open, close, dividend, split_coefficient
FROM {panel} JOIN {schedule} USING (session) WHERE i >= 1
UNION ALL SELECT symbol, session, period - 1, true, open, close, dividend, split_coefficient
FROM {panel} JOIN {schedule} USING (session) WHERE executes AND period > 0""",
        "slot_shares": f"""
SELECT *, product(CASE WHEN later THEN split_coefficient ELSE 1.0 END) OVER ({sp} {UP}) AS shares
FROM (SELECT *, row_number() OVER ({sp}) > 1 AS later FROM slots)""",
        "units": f"""
SELECT symbol, period, session, exit, first_value(session) OVER ({sp} {UP}) AS entry_session,
       shares * CASE WHEN exit THEN open ELSE close END / first_value(open) OVER ({sp} {UP}) AS unit_stock,
       sum(CASE WHEN later THEN shares * dividend ELSE 0.0 END) OVER ({sp} {UP}) / first_value(open) OVER ({sp} {UP}) AS unit_income
FROM slot_shares""",
        "parts": f"""
SELECT t.strategy, u.period, u.symbol, u.session, u.exit, u.entry_session, t.weight, t.weight * u.unit_stock AS stock,
       t.weight * (u.unit_stock + u.unit_income) AS part
FROM targets t JOIN {schedule} s ON s.session = t.decision AND s.decides
JOIN units u ON u.symbol = t.symbol AND u.period = s.decision_period""",
        "held": "SELECT strategy, period, session, exit, sum(part) AS invested, sum(weight) AS weight FROM parts GROUP BY ALL",
        "exits": "SELECT strategy, period + 1 AS period, 1 - weight + invested AS carried FROM held WHERE exit",
        "turnovers": """
SELECT strategy, period, sum(abs(change)) AS turnover FROM (
  SELECT strategy, period, symbol, sum(change) AS change FROM (
    SELECT strategy, period, symbol, weight AS change FROM parts WHERE session = entry_session AND NOT exit
    UNION ALL SELECT p.strategy, p.period + 1, p.symbol, -p.stock / e.carried FROM parts p
    JOIN exits e ON e.strategy = p.strategy AND e.period = p.period + 1 WHERE p.exit)
  GROUP BY ALL) GROUP BY ALL""",
        "days": f"SELECT * FROM {schedule}, (SELECT unnest([{listed}]) AS strategy)",
        "steps": f"""
SELECT strategy, period, coalesce(turnover, 0.0) AS turnover, 1 - {cost} * coalesce(turnover, 0.0) AS net,
       product(coalesce(carried, 1.0)) OVER (PARTITION BY strategy ORDER BY period) AS gross,
       coalesce(product(1 - {cost} * coalesce(turnover, 0.0)) OVER (PARTITION BY strategy ORDER BY period
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS before
FROM days LEFT JOIN exits USING (strategy, period) LEFT JOIN turnovers USING (strategy, period) WHERE executes""",
        "bench_curve": f"""
SELECT session, close / first_value(open) OVER (ORDER BY session {UP}) AS benchmark_equity
FROM bench SEMI JOIN {schedule} USING (session)""",
        "curve": f"""
SELECT d.strategy, session, d.i, coalesce(gross * before * net, 1.0)
         * CASE WHEN d.i = 0 THEN 1.0 ELSE 1 - coalesce(h.weight, 0.0) + coalesce(h.invested, 0.0) END AS equity,
       CASE WHEN executes THEN turnover ELSE 0.0 END AS turnover,
       CASE WHEN executes THEN {cost} * turnover * gross * before ELSE 0.0 END AS cost, benchmark_equity
FROM days d LEFT JOIN (SELECT * FROM held WHERE NOT exit) h USING (strategy, session)
LEFT JOIN steps s ON s.strategy = d.strategy AND s.period = d.period JOIN bench_curve USING (session)""",
    }


def swept(cost: float) -> dict[str, str]:
    return {"decisions": decisions_cte(), "ranked": ranked_cte(), "targets": targets_cte(), **curve_ctes(cost)}


CURVE = f"""SELECT strategy, session, {r('equity')} AS equity, {r('benchmark_equity')} AS benchmark_equity,
{r('turnover')} AS turnover, {r('cost', 8)} AS cost FROM curve"""
POINT_METRICS = metrics_ctes("points", "symbol, candidate", "p")


def point_metrics(*names: str) -> str:
    return with_("points", metric_select("metrics_p", "symbol, candidate", names), **POINT_METRICS)


def sweep(base: str, names, sources: str = "panel_momentum schedule bench", added: dict[str, str] | None = None) -> str:
    """Metrics of all strategies; `added` maps further strategy names to their targets (decision, symbol, weight)."""
    added = added or {}
    targets = "".join(f" UNION ALL SELECT '{name}', decision, symbol, weight FROM ({rows})" for name, rows in added.items())
    extra = {
        "decisions": decisions_cte(), "ranked": ranked_cte(), "targets": targets_cte() + targets,
        **curve_ctes(C, names=[*NAMES, *added]), "swept": base, "stage_rows": stages_cte("swept", "strategy", 40, (0, 0)),
        "staged": """SELECT p.*, stage FROM swept p JOIN stage_rows ON i >= start_i AND i < end_i
UNION ALL SELECT *, 'full_period' FROM swept WHERE i >= 40""",
        **metrics_ctes("staged", "strategy, stage", "s"),
    }
    return with_(sources, metric_select("metrics_s", "strategy, stage", names), **extra)


SQL = {
    "strategy_signals": with_("signals", "SELECT symbol, session, candidate, signal FROM signals"),
    "long_flat_curve": with_("points", f"""
SELECT symbol, candidate, session, target, {r('equity')} AS equity, {r('cost')} AS cost FROM points"""),
    "benchmark_curve": with_("points", f"""
SELECT symbol, session, {r('benchmark_equity')} AS benchmark_equity FROM points WHERE candidate = 'cash'"""),
    "performance_metrics": point_metrics(*METRICS, *HITS),
    "period_hit_metrics": point_metrics(*HITS),
    "tail_risk": point_metrics("value_at_risk_95", "expected_shortfall_95"),
    "capture_ratios": point_metrics("upside_capture", "downside_capture"),
    "curve_beta": point_metrics("beta", "alpha"),
    "stage_slices": with_("points", """
SELECT symbol, candidate, stage, count(*) AS n, min(i) AS first_i, max(session) AS last_session
FROM points JOIN stage_rows ON i >= start_i AND i < end_i GROUP BY ALL""",
        stage_rows=stages_cte("points", "symbol, candidate", 0, (30, 15))),
    "stage_means": with_("points", metric_select("means", "candidate, stage", MEANS), **COMPARED),
    "best_strategy": with_("points", f"""
SELECT candidate AS selected, {r('mean_information_ratio')} AS mean_information_ratio
FROM means JOIN chosen ON selected = candidate WHERE stage = 'development'""", **COMPARED),
    "comparison_gates": with_("points", GATE_ROWS, **COMPARED),
    "comparison_eligible": with_("points", f"SELECT candidate, bool_and(passed) AS approved FROM ({GATE_ROWS}) GROUP BY candidate",
                                 **COMPARED),
    "compare_strategies": with_("points", metric_select("means", "candidate, stage", MEANS).replace(
        " FROM means", ", candidate = (SELECT selected FROM chosen) AS selected FROM means"), **COMPARED),
    "rebalance_schedule": with_("schedule", "SELECT session, i, next_session AS executes_on FROM schedule WHERE decides"),
    "equal_weight_targets": with_("panel schedule", f"""
SELECT session AS decision, symbol, {r('1.0 / count(*) OVER (PARTITION BY session)')} AS weight
FROM panel JOIN schedule USING (session) WHERE decides"""),
    "ranked_momentum_targets": with_("panel_momentum schedule", f"""
SELECT strategy, decision, symbol, position, {r('momentum')} AS momentum, {r('weight')} AS weight FROM ranked""",
        decisions=decisions_cte(), ranked=ranked_cte()),
    "rebalanced_gross_curve": with_("panel_momentum schedule bench", CURVE, **swept(0.0)),
    "rebalanced_net_curve": with_("panel_momentum schedule bench", CURVE, **swept(C)),
    "warmup_curve": with_("panel_momentum bench common", CURVE,
        late_sessions=f"SELECT session FROM common WHERE session >= {START}",
        late_schedule=schedule_cte("late_sessions"), late_panel=f"SELECT * FROM panel WHERE session >= {START}",
        decisions=decisions_cte("late_schedule"), ranked=ranked_cte(), targets=targets_cte(),
        **curve_ctes(C, "late_panel", "late_schedule")),
    "position_weights": with_("panel_momentum schedule bench", f"""
SELECT strategy, session, symbol, {r('stock / (1 - sum(weight) OVER w + sum(part) OVER w)')} AS weight
FROM parts WHERE NOT exit WINDOW w AS (PARTITION BY strategy, session)""", **swept(0.0)),
    "weight_check": with_("panel_momentum schedule", f"""
SELECT strategy, decision, {r('min(weight)')} AS lowest, {r('sum(weight)')} AS total,
       min(weight) >= 0 AND sum(weight) <= 1 + 1e-12 AS valid
FROM (SELECT strategy, decision, CASE WHEN symbol = 'Brand-3' AND month(decision) = 5 THEN -weight
        WHEN symbol = 'Brand-4' AND month(decision) = 6 THEN weight * 2 ELSE weight END AS weight FROM targets)
GROUP BY strategy, decision""", decisions=decisions_cte(), ranked=ranked_cte(), targets=targets_cte()),
    "annual_turnover": with_("panel_momentum schedule bench", f"""
SELECT strategy, {r("sum(turnover) / greatest(date_diff('day', min(session), max(session)) / 365.25, 1.0 / 252)")} AS annual_turnover
FROM curve GROUP BY strategy""", **swept(C)),
    "window_completeness": with_("bars bench", f"""
SELECT symbol, count(DISTINCT session) AS present, (SELECT count(*) FROM wanted) - count(DISTINCT session) AS missing,
       (SELECT count(*) FROM wanted) = count(DISTINCT session) AS complete
FROM (SELECT DISTINCT symbol FROM bars UNION ALL SELECT 'Brand-99') LEFT JOIN (
  SELECT symbol, session FROM bars JOIN wanted USING (session) WHERE volume % 7 > 0 OR symbol > 'Brand-2') USING (symbol) GROUP BY symbol""",
        wanted=f"SELECT session FROM bench WHERE session >= {START}"),
    "universe_sweep": sweep("SELECT * FROM curve", METRICS + HITS),
    "equal_weight_benchmark_sweep": sweep("""
SELECT c.strategy, c.session, c.i, c.equity, c.cost, c.turnover, e.equity AS benchmark_equity
FROM curve c JOIN (SELECT session, equity FROM curve WHERE strategy = 'equal_weight') e USING (session)""",
        ("excess_return", "information_ratio", "benchmark_total_return", "tracking_error", "beta")),
    "available_sessions": with_("bars", f"""
SELECT count(*) AS requested, count(*) FILTER (n < 250) AS excluded, {r('avg(n) FILTER (n >= 250)')} AS mean_available_sessions
FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)"""),
    "valuation_series": with_("panel_momentum schedule bench", """
SELECT *, sha256(concat_ws('|', strategy, CAST(session AS VARCHAR), CAST(CAST(round(portfolio_value * 1000000) AS BIGINT) AS VARCHAR),
  CAST(CAST(round(benchmark_value * 1000000) AS BIGINT) AS VARCHAR))) AS row_hash FROM valued""", **swept(C), valued=f"""
SELECT strategy, session, {r('equity')} AS portfolio_value, {r('benchmark_equity')} AS benchmark_value,
       {r('equity / first_value(equity) OVER w - 1')} AS total_return,
       {r('benchmark_equity / first_value(benchmark_equity) OVER w - 1')} AS benchmark_return,
       {r('equity / first_value(equity) OVER w - benchmark_equity / first_value(benchmark_equity) OVER w')} AS excess_return,
       {r('equity / max(equity) OVER w - 1')} AS drawdown
FROM curve WINDOW w AS (PARTITION BY strategy ORDER BY session)"""),
}
