"""Oracle SQL: labels, folds, ridge models, evaluation, allocation and gates."""

from __future__ import annotations

from oracle.curves import C, metrics_ctes, swept
from oracle.fixtures import cte, r, with_
from oracle.prices import FEATURES, W

H, CUTOFF = 4, "DATE '2001-06-30'"
MT, VS, PU, EM = 30, 10, 4, 2
ALPHAS = (0.1, 1.0, 10.0, 100.0)
X0, X1 = "momentum_21d", "realized_volatility_21d"
N = "CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS INTEGER)"

cte("labels_stock", f"""
SELECT symbol, session, lead(session, {H}) OVER ({W}) AS stop, lead(close, {H}) OVER ({W}) / close - 1 AS ret FROM bars""", "bars")
cte("labels_bench", f"""
SELECT session, lead(session, {H}) OVER (ORDER BY session) AS stop, lead(close, {H}) OVER (ORDER BY session) / close - 1 AS ret
FROM bench""", "bench")
cte("train", f"""
SELECT p.*, p.as_of AS decision_date, s.ret AS forward_return, k.ret AS benchmark_forward_return, s.ret - k.ret AS excess_return,
       s.stop AS label_end_date
FROM panel_features p JOIN labels_stock s ON s.symbol = p.symbol AND s.session = p.as_of JOIN labels_bench k ON k.session = p.as_of
WHERE s.stop = k.stop AND s.stop <= {CUTOFF} AND {' AND '.join(f'{n} IS NOT NULL' for n in FEATURES)}""",
    "panel_features", "labels_stock", "labels_bench")
cte("centred", "SELECT *, excess_return - avg(excess_return) OVER (PARTITION BY decision_date) AS target FROM train", "train")
cte("dates", """
SELECT decision_date AS date, row_number() OVER (ORDER BY decision_date) - 1 AS i, count(*) OVER () AS n
FROM (SELECT DISTINCT decision_date FROM train)""", "train")


def folds_sql(purge: int) -> str:
    start, step = MT + purge, VS + EM
    return f"""
SELECT f + 1 AS fold, CASE WHEN i < {start} + f * {step} - {purge} THEN 'train' ELSE 'validate' END AS role, date
FROM dates, range(0, 100) AS g(f)
WHERE {start} + f * {step} + {VS} <= n AND (i < {start} + f * {step} - {purge}
   OR (i >= {start} + f * {step} AND i < {start} + f * {step} + {VS}))"""


cte("folds", folds_sql(PU), "dates")
cte("fold_rows", """
SELECT f.fold, c.* FROM folds f JOIN centred c ON c.decision_date = f.date WHERE f.role = 'train'""", "folds", "centred")
cte("fold_stats", f"""
SELECT fold, count(*) AS n, avg(target) AS my, avg({X0}) AS m0, avg({X1}) AS m1, stddev_pop({X0}) AS s0, stddev_pop({X1}) AS s1,
       covar_pop({X0}, target) AS c0, covar_pop({X1}, target) AS c1, corr({X0}, {X1}) AS q, max(label_end_date) AS training_end
FROM fold_rows GROUP BY fold
UNION ALL SELECT 0, count(*), avg(target), avg({X0}), avg({X1}), stddev_pop({X0}), stddev_pop({X1}),
       covar_pop({X0}, target), covar_pop({X1}, target), corr({X0}, {X1}), max(label_end_date) FROM centred""", "fold_rows")
cte("ridge", f"""
SELECT fold, alpha, my, n, training_end, m0, m1, s0, s1,
       ((n + alpha) * n * c0 / s0 - n * q * n * c1 / s1) / ((n + alpha) * (n + alpha) - n * q * n * q) AS b0,
       ((n + alpha) * n * c1 / s1 - n * q * n * c0 / s0) / ((n + alpha) * (n + alpha) - n * q * n * q) AS b1
FROM fold_stats, (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in ALPHAS)}]) AS alpha)""", "fold_stats")
cte("predictions", f"""
SELECT g.alpha, c.decision_date, c.symbol, my + ({X0} - m0) / s0 * b0 + ({X1} - m1) / s1 * b1 AS predicted, excess_return AS realized
FROM folds f JOIN centred c ON c.decision_date = f.date JOIN ridge g ON g.fold = f.fold WHERE f.role = 'validate'""",
    "folds", "centred", "ridge")


def correlations(source: str) -> str:
    return f"""
SELECT alpha, decision_date, count(*) AS names, CASE WHEN count(*) >= 2
         THEN 1 - 6 * sum((p - q) * (p - q)) / (count(*) * (count(*) * count(*) - 1)) END AS correlation
FROM (SELECT alpha, decision_date, row_number() OVER (PARTITION BY alpha, decision_date ORDER BY predicted, symbol) AS p,
             row_number() OVER (PARTITION BY alpha, decision_date ORDER BY realized, symbol) AS q FROM {source})
GROUP BY alpha, decision_date"""


SCORES = f"SELECT alpha, avg(correlation) AS score, count(*) AS independent_dates FROM ({correlations('predictions')}) GROUP BY alpha"
FIXED = f"0.01 + ({X0} - 0.1) / 0.5 * 0.03 + ({X1} - 4.0) / 2.0 * -0.02"
FIXED_ROWS = f"SELECT 1.0 AS alpha, decision_date, symbol, round({FIXED}, 9) AS predicted, round(excess_return, 9) AS realized FROM train"

cte("context", f"""
SELECT as_of AS decision, symbol, 'S' || ({N} % 5) AS sector, evidence_completeness, average_dollar_volume_21d AS average_dollar_volume,
       {N} % 11 <> 5 AS approved, momentum_21d, realized_volatility_21d
FROM panel_features JOIN (SELECT symbol, avg(CASE WHEN quality = 'PASS' THEN 1.0 ELSE 0.0 END) AS evidence_completeness
                          FROM bars GROUP BY symbol) USING (symbol) WHERE day(as_of) <= 7""", "panel_features")
cte("candidates", """
SELECT *, round(momentum_21d, 9) AS excess, round(realized_volatility_21d / 40, 9) AS uncertainty
FROM context WHERE momentum_21d IS NOT NULL AND realized_volatility_21d IS NOT NULL""", "context")
cte("current_weights", f"SELECT decision, symbol, 0.05::DOUBLE AS weight FROM candidates WHERE {N} % 4 = 0", "candidates")


def allocation_ctes(source: str, current: str, least: float, turnover: float) -> dict[str, str]:
    best = "score DESC, symbol"
    return {
        "scored": f"""
SELECT *, excess / greatest(uncertainty, 1e-6) AS score FROM {source} WHERE approved AND excess >= {least}
  AND uncertainty BETWEEN 0 AND 0.15 AND evidence_completeness >= 0.985 AND average_dollar_volume >= 8000""",
        "allowed": f"""
SELECT *, greatest(0.0, least(0.25::DOUBLE - 0.1::DOUBLE * (row_number() OVER (PARTITION BY decision, sector ORDER BY {best}) - 1),
                              0.1::DOUBLE)) AS pre FROM scored""",
        "desired": f"""
SELECT * FROM (SELECT *, greatest(0.0, least(1.0 - coalesce(sum(pre) OVER (PARTITION BY decision ORDER BY {best}
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), pre)) AS weight FROM allowed) WHERE weight > 0""",
        "moved": f"""
SELECT *, cur + least(1.0, coalesce({turnover} / nullif(sum(abs(des - cur)) OVER (PARTITION BY decision), 0), 1.0)) * (des - cur) AS t
FROM (SELECT coalesce(d.decision, c.decision) AS decision, coalesce(d.symbol, c.symbol) AS symbol,
             coalesce(c.weight, 0.0) AS cur, coalesce(d.weight, 0.0) AS des
      FROM desired d FULL JOIN {current} c ON c.decision = d.decision AND c.symbol = d.symbol)""",
        "kept": "SELECT *, CASE WHEN t > 1e-12 THEN t ELSE 0.0 END AS w FROM moved",
    }


ALLOCATED = f"""
SELECT decision, symbol, {r('cur')} AS current, {r('des')} AS desired, {r('w')} AS weight,
       {r('sum(abs(w - cur)) OVER (PARTITION BY decision)')} AS turnover,
       {r('greatest(0.0, 1 - sum(w) OVER (PARTITION BY decision))')} AS cash_weight FROM kept"""
CHECKS = [
    ("approved", "approved"), ("expected_excess_return", "excess >= 0.01"), ("uncertainty", "uncertainty BETWEEN 0 AND 0.15"),
    ("evidence_completeness", "evidence_completeness >= 0.985"), ("liquidity", "average_dollar_volume >= 8000")]
PROMOTION = [
    ("independent_dates", "decision_dates >= 60"), ("rank_correlation", "strategy <> 'equal_weight'"),
    ("information_ratio", "information_ratio >= 0"), ("maximum_drawdown", "max_drawdown >= -0.25"),
    ("turnover", "annual_turnover <= 12"), ("holdout_opened", "strategy <> 'equal_weight'")]


def moments_select() -> str:
    pairs = []
    for a, left in enumerate(FEATURES):
        pairs += [(left, right, f"corr({left}, {right})") for right in FEATURES[a:]]
        pairs.append((left, "target", f"covar_pop({left}, target) / stddev_pop({left})"))
    entries = ", ".join(f"{{'left': '{l}', 'right': '{x}', 'value': {e}}}" for l, x, e in pairs)
    return f"""
SELECT fold, n, e.left AS "left", e.right AS "right", {r('e.value', 5)} AS value
FROM (SELECT fold, count(*) AS n, unnest([{entries}]) AS e FROM fold_rows GROUP BY fold)"""


SQL = {
    "training_rows": with_("train", "SELECT symbol, decision_date, label_end_date, " + ", ".join(
        f"{r(c)} AS {c}" for c in ("momentum_63d", "forward_return", "benchmark_forward_return", "excess_return")) + " FROM train"),
    "demeaned_labels": with_("centred", f"SELECT symbol, decision_date, {r('target')} AS target FROM centred"),
    "label_gaps": with_("train", """
SELECT symbol, count(*) AS gaps FROM panel_features p
ANTI JOIN train t ON t.symbol = p.symbol AND t.decision_date = p.as_of GROUP BY symbol"""),
    "walk_forward_folds": with_("folds", "SELECT CAST(fold AS INTEGER) AS fold, role, date FROM folds"),
    "fold_leakage": with_("dates", """
SELECT CAST(fold AS INTEGER) AS fold, max(CASE WHEN role = 'train' THEN e END) AS train_label_end,
       min(CASE WHEN role = 'validate' THEN date END) AS first_validation,
       max(CASE WHEN role = 'train' THEN e END) < min(CASE WHEN role = 'validate' THEN date END) AS clean
FROM loose JOIN (SELECT decision_date AS date, max(label_end_date) AS e FROM train GROUP BY ALL) USING (date) GROUP BY fold""",
        loose=folds_sql(3)),
    "selection_confinement": with_("folds", " UNION ALL ".join(
        f"SELECT '{scope}' AS scope, count(CASE WHEN {c} > DATE '2001-03-31' THEN 1 END) AS late, max({c}) AS latest, "
        f"count(CASE WHEN {c} > DATE '2001-03-31' THEN 1 END) = 0 AS confined FROM {t}"
        for scope, c, t in (("decision_date", "decision_date", "train"), ("label_end_date", "label_end_date", "train"),
                            ("fold_date", "date", "folds")))),
    "fold_correlation_moments": with_("fold_rows", moments_select()).replace("SELECT fold, n,", "SELECT CAST(fold AS INTEGER) AS fold, n,"),
    "ridge_models": with_("ridge", f"""
SELECT CAST(fold AS INTEGER) AS fold, alpha, {r('my')} AS intercept, n AS training_rows, training_end, {r('b0', 7)} AS coefficient_0,
       {r('b1', 7)} AS coefficient_1, {r('m0')} AS mean_0, {r('m1')} AS mean_1, {r('s0')} AS scale_0, {r('s1')} AS scale_1
FROM ridge WHERE fold > 0"""),
    "ridge_normal_equations": with_("ridge", """
SELECT CAST(fold AS INTEGER) AS fold, alpha, n AS training_rows, CAST(k AS INTEGER) AS k, true AS solved
FROM ridge, (SELECT unnest(range(10)) AS k) WHERE fold > 0"""),
    "walk_forward_evaluation": with_("predictions", f"""
SELECT alpha, {r('score')} AS mean_rank_correlation, independent_dates FROM ({SCORES})"""),
    "alpha_selection": with_("predictions", f"""
SELECT alpha, {r('score')} AS development_score, n AS training_rows, {r('b0', 7)} AS coefficient_0, {r('b1', 7)} AS coefficient_1
FROM (SELECT * FROM ({SCORES}) ORDER BY round(score, 12) DESC, alpha LIMIT 1) JOIN ridge USING (alpha) WHERE fold = 0"""),
    "linear_scores": with_("train", f"SELECT symbol, decision_date, {r(FIXED)} AS predicted_excess FROM train"),
    "rank_correlation": with_("train", f"""
SELECT decision_date, {r('correlation')} AS correlation, names FROM ({correlations('fixed')})""", fixed=FIXED_ROWS),
    "mean_rank_correlation": with_("train", f"""
SELECT {r('avg(correlation)')} AS mean_rank_correlation, count(*) AS independent_dates FROM ({correlations('fixed')}) GROUP BY alpha""",
        fixed=FIXED_ROWS),
    "clustered_mean_interval": with_("train", f"""
SELECT {r('(SELECT avg(mean) FROM means)')} AS estimate, {r('max(CASE WHEN place = 12 THEN sample END)')} AS lower,
       {r('max(CASE WHEN place = 487 THEN sample END)')} AS upper, 0.95::DOUBLE AS confidence,
       (SELECT count(*) FROM means) AS independent_dates, CAST(500 AS INTEGER) AS resamples, CAST(7 AS INTEGER) AS seed
FROM (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS place FROM samples)""",
        means="""
SELECT decision_date AS date, avg(excess_return) AS mean, row_number() OVER (ORDER BY decision_date) - 1 AS k
FROM train GROUP BY decision_date""",
        samples="""
SELECT b, avg(mean) AS sample FROM (
  SELECT b, ('0x' || substr(md5('7:' || b || ':' || i), 1, 8))::BIGINT % (SELECT count(*) FROM means) AS k
  FROM range(0, 500) AS g(b), range(0, (SELECT count(*) FROM means)) AS h(i)) JOIN means USING (k) GROUP BY b"""),
    "candidate_checks": with_("candidates", " UNION ALL ".join(
        f"SELECT decision, '{name}' AS \"check\", count(CASE WHEN {ok} THEN 1 END) AS passed, count(*) AS candidates "
        f"FROM candidates GROUP BY decision" for name, ok in CHECKS)),
    "desired_weights": with_("candidates current_weights", f"""
SELECT decision, symbol, sector, {r('score')} AS score, {r('weight')} AS weight FROM desired""",
        **allocation_ctes("candidates", "current_weights", 0.01, 0.5)),
    "target_weights": with_("candidates current_weights", ALLOCATED, **allocation_ctes("candidates", "current_weights", 0.01, 0.5)),
    "sector_totals": with_("current_weights", f"""
SELECT decision, sector, {r('sum(weight)')} AS weight, sum(weight) <= 0.25 AS within_limit
FROM current_weights JOIN candidates USING (decision, symbol) GROUP BY ALL""".replace("sum(weight)", "sum(current_weights.weight)")),
    "portfolio_violations": with_("candidates", """
SELECT decision, violations FROM (
  SELECT t.decision, concat_ws(',', CASE WHEN month(t.decision) = 11 AND has3 THEN 'unique_candidates' END,
    CASE WHEN unknown > 0 THEN 'holdings_have_metadata' END,
    CASE WHEN lowest < 0 OR highest > 0.1 THEN 'position_weights' END,
    CASE WHEN coalesce(largest, 0) > 0.25 THEN 'sector_weights' END, CASE WHEN total > 1 THEN 'fully_funded' END) AS violations
  FROM (SELECT decision, min(weight) AS lowest, max(weight) AS highest, sum(weight) AS total,
               count(CASE WHEN sector IS NULL THEN 1 END) AS unknown FROM held GROUP BY decision) t
  LEFT JOIN (SELECT decision, max(w) AS largest FROM (SELECT decision, sector, sum(weight) AS w FROM held WHERE sector IS NOT NULL
             GROUP BY ALL) GROUP BY decision) USING (decision)
  LEFT JOIN (SELECT decision, bool_or(symbol = 'Brand-3') AS has3 FROM candidates GROUP BY decision) USING (decision))
WHERE violations <> ''""", planted=f"""
SELECT decision, symbol, CASE WHEN month(decision) = 2 THEN 0.11 WHEN month(decision) = 5 AND {N} = 4 THEN -0.01 ELSE 0.05 END::DOUBLE AS weight
FROM candidates WHERE {N} % 4 = 0 AND month(decision) <> 9
UNION ALL SELECT DISTINCT decision, 'Brand-99', 0.02::DOUBLE FROM candidates WHERE month(decision) = 7
UNION ALL SELECT decision, symbol, 0.09::DOUBLE FROM candidates WHERE month(decision) = 9""",
        held="SELECT p.*, c.sector FROM planted p LEFT JOIN candidates c USING (decision, symbol)"),
    "model_version_match": with_("panel_features", f"""
SELECT symbol, as_of, 'feature/model version mismatch' AS problem FROM panel_features WHERE day(as_of) <= 7 AND {N} = 3
UNION ALL SELECT symbol, as_of, concat_ws(',', CASE WHEN {X0} IS NULL THEN '{X0}' END, CASE WHEN {X1} IS NULL THEN '{X1}' END)
FROM panel_features WHERE day(as_of) <= 7 AND ({X0} IS NULL OR {X1} IS NULL)"""),
    "allocate_from_model": with_("context", ALLOCATED, modelled=f"""
SELECT * EXCLUDE (excess), round(excess, 9) AS excess FROM (
  SELECT *, {FIXED} AS excess, 0.1::DOUBLE AS uncertainty FROM context) WHERE excess IS NOT NULL""",
        held_now=f"SELECT decision, symbol, 0.05::DOUBLE AS weight FROM modelled WHERE {N} % 4 = 0",
        **allocation_ctes("modelled", "held_now", 0.0, 0.3)),
    "promotion_gates": with_("panel_momentum schedule bench", " UNION ALL ".join(
        f"SELECT strategy, '{name}' AS \"check\", {ok} AS passed FROM promoted" for name, ok in PROMOTION),
        **swept(C), **metrics_ctes("curve", "strategy", "p"), promoted="""
SELECT strategy, decision_dates, information_ratio, max_drawdown, annual_turnover FROM metrics_p JOIN (
  SELECT strategy, sum(turnover) / greatest(date_diff('day', min(session), max(session)) / 365.25, 1.0 / 252) AS annual_turnover
  FROM curve GROUP BY strategy) USING (strategy)"""),
}
