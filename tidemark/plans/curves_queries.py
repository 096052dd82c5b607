"""Registered queries: signals, curves, metrics, strategy selection and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.columns import r
from tidemark.operators import asof, curves, gates, metrics, quality, strategies
from tidemark.plans import compare
from tidemark.plans import driver_tables as d
from tidemark.plans.prices_queries import panel
from tidemark.session import materialize

LOOKBACKS = (5, 10, 21)
EVERY = 8
TOP = 5
COST = 5.0
START = "1996-06-03"


def signals(spark, sf):
    bars, bench = panel(spark, sf)
    return curves.with_signals(curves.align(bars, bench), LOOKBACKS).select("symbol", "session", "candidate", "signal")


def points(spark, sf):
    bars, bench = panel(spark, sf)
    return curves.long_flat_curves(bars, bench, LOOKBACKS, COST)


def long_flat_curve(spark, sf):
    return points(spark, sf).select(
        "symbol", "candidate", "session", "target", r("equity").alias("equity"), r("cost").alias("cost"))


def benchmark_curve(spark, sf):
    return points(spark, sf).filter("candidate = 'cash'").select(
        "symbol", "session", r("benchmark_equity").alias("benchmark_equity"))


def rounded_metrics(rows, keys):
    names = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *[r(c).alias(c) for c in names])


def performance(spark, sf):
    keys = ["symbol", "candidate"]
    return rounded_metrics(metrics.performance_metrics(points(spark, sf), keys), keys)


def metric_subset(*names):
    def query(spark, sf):
        keys = ["symbol", "candidate"]
        return rounded_metrics(metrics.performance_metrics(points(spark, sf), keys).select(*keys, *names), keys)
    return query


def period_hits(spark, sf):
    keys = ["symbol", "candidate"]
    return rounded_metrics(metrics.period_hit_metrics(points(spark, sf), keys), keys)


def stage_points(spark, sf):
    rows = points(spark, sf)
    sliced = strategies.slice_stages(rows, strategies.stages(rows, 0, compare.MINIMUM_STAGES))
    return sliced.groupBy("symbol", "candidate", "stage").agg(
        F.count("*").alias("n"), F.min("i").cast("bigint").alias("first_i"), F.max("session").alias("last_session"))


def comparison(spark, sf):
    bars, bench = panel(spark, sf)
    return compare.compare_candidates(bars, bench, LOOKBACKS, COST)


def stage_means(spark, sf):
    rows = comparison(spark, sf).drop("selected")
    return rounded_metrics(rows, ["candidate", "stage"])


def best_strategy(spark, sf):
    rows = comparison(spark, sf)
    return rows.filter("selected AND stage = 'development'").select(
        F.col("candidate").alias("selected"), r("mean_information_ratio").alias("mean_information_ratio"))


def comparison_gates(spark, sf):
    return gates.comparison_gates(comparison(spark, sf), 60, -0.25, False)


def comparison_eligible(spark, sf):
    return gates.all_pass(comparison_gates(spark, sf), ["candidate"])


def compare_strategies(spark, sf):
    rows = comparison(spark, sf)
    return rounded_metrics(rows.drop("selected"), ["candidate", "stage"]).join(
        rows.select("candidate", "stage", "selected"), ["candidate", "stage"])


def fixed_panel(spark, sf):
    bars, bench = panel(spark, sf)
    sessions = materialize(curves.common_sessions(bars, bench))
    kept = bars.join(F.broadcast(sessions), "session", "left_semi")
    return kept, bench, curves.rebalance_calendar(sessions, EVERY)


def rebalance_schedule(spark, sf):
    _, _, schedule = fixed_panel(spark, sf)
    return schedule.filter("decides").select(
        "session", F.col("i").cast("bigint").alias("i"), F.col("next_session").alias("executes_on"))


def equal_weight(spark, sf):
    rows, _, schedule = fixed_panel(spark, sf)
    decisions = strategies.decision_panel(rows, schedule, LOOKBACKS)
    return strategies.equal_weight_targets(decisions).select("decision", "symbol", r("weight").alias("weight"))


def ranked_momentum(spark, sf):
    rows, _, schedule = fixed_panel(spark, sf)
    decisions = strategies.decision_panel(rows, schedule, LOOKBACKS)
    return strategies.ranked_momentum_targets(decisions, LOOKBACKS, TOP).select(
        "strategy", "decision", "symbol", F.col("position").cast("bigint").alias("position"),
        r("momentum").alias("momentum"), r("weight").alias("weight"))


def rebalanced(cost):
    def build(spark, sf):
        rows, bench, schedule = fixed_panel(spark, sf)
        targets, names = compare.sweep_targets(rows, schedule, LOOKBACKS, TOP)
        return curves.rebalanced_curve(rows, bench, schedule, targets, names, cost)
    return build


def curve_columns(rows):
    return rows.select(
        "strategy", "session", r("equity").alias("equity"), r("benchmark_equity").alias("benchmark_equity"),
        r("turnover").alias("turnover"), r("cost", 8).alias("cost"))


def gross_curve(spark, sf):
    return curve_columns(rebalanced(0.0)(spark, sf))


def net_curve(spark, sf):
    return curve_columns(rebalanced(COST)(spark, sf))


def position_weights(spark, sf):
    rows, _, schedule = fixed_panel(spark, sf)
    targets, _ = compare.sweep_targets(rows, schedule, LOOKBACKS, TOP)
    return curves.position_weights(rows, schedule, targets).select(
        "strategy", "session", "symbol", r("weight").alias("weight"))


def weight_check(spark, sf):
    rows, _, schedule = fixed_panel(spark, sf)
    targets, _ = compare.sweep_targets(rows, schedule, LOOKBACKS, TOP)
    planted = targets.withColumn("weight", F.when(
        (F.col("symbol") == "Brand-3") & (F.month("decision") == 5), -F.col("weight"))
        .when((F.col("symbol") == "Brand-4") & (F.month("decision") == 6), F.col("weight") * 2)
        .otherwise(F.col("weight")))
    return quality.weight_violations(planted, ["strategy", "decision"]).select(
        "strategy", "decision", r("lowest").alias("lowest"), r("total").alias("total"), "valid")


def annual_turnover(spark, sf):
    return metrics.annual_turnover(rebalanced(COST)(spark, sf), ["strategy"]).select(
        "strategy", r("annual_turnover").alias("annual_turnover"))


def warmup_curve(spark, sf):
    """Targets see all bars; capital starts at the evaluation date."""
    bars, bench = panel(spark, sf)
    sessions = materialize(curves.common_sessions(bars, bench))
    rows = bars.join(F.broadcast(sessions), "session", "left_semi")
    start = F.to_date(F.lit(START))
    schedule = curves.rebalance_calendar(sessions.filter(F.col("session") >= start), EVERY)
    targets, names = compare.sweep_targets(rows, schedule, LOOKBACKS, TOP)
    return curve_columns(curves.rebalanced_curve(
        rows.filter(F.col("session") >= start), bench, schedule, targets, names, COST))


def window_completeness(spark, sf):
    bars, bench = panel(spark, sf)
    wanted = bench.filter(F.col("session") >= F.to_date(F.lit(START))).select("session")
    held = bars.filter("volume % 7 > 0 OR symbol > 'Brand-2'")
    # One listed symbol never traded.
    symbols = bars.select("symbol").distinct().unionByName(spark.range(1).select(F.lit("Brand-99").alias("symbol")))
    return asof.window_completeness(symbols, wanted, held)


def universe_sweep(spark, sf):
    bars, bench = panel(spark, sf)
    rows = compare.universe_sweep(bars, bench, LOOKBACKS, TOP, EVERY, warmup=40, cost_bps=COST)
    return rounded_metrics(rows, ["strategy", "stage"])


def equal_weight_benchmark_sweep(spark, sf):
    bars, bench = panel(spark, sf)
    rows = compare.universe_sweep(
        bars, bench, LOOKBACKS, TOP, EVERY, warmup=40, cost_bps=COST, benchmark_label="equal_weight")
    return rounded_metrics(rows.select(
        "strategy", "stage", "excess_return", "information_ratio", "benchmark_total_return", "tracking_error",
        "beta"), ["strategy", "stage"])


def available_sessions(spark, sf):
    counts = d.bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("requested"), F.count_if(F.col("n") < 250).alias("excluded"),
        r(F.avg(F.when(F.col("n") >= 250, F.col("n")))).alias("mean_available_sessions"))


def valuation_series(spark, sf):
    """Daily valuations with running peak and drawdown, and one hash per row."""
    curve = rebalanced(COST)(spark, sf)
    seen = W.partitionBy("strategy").orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    first = lambda c: F.first(c).over(seen)
    rows = curve.select(
        "strategy", "session", r("equity").alias("portfolio_value"), r("benchmark_equity").alias("benchmark_value"),
        r(F.col("equity") / first("equity") - 1).alias("total_return"),
        r(F.col("benchmark_equity") / first("benchmark_equity") - 1).alias("benchmark_return"),
        r(F.col("equity") / first("equity") - F.col("benchmark_equity") / first("benchmark_equity"))
        .alias("excess_return"),
        r(F.col("equity") / F.max("equity").over(seen) - 1).alias("drawdown"))
    from tidemark.functions.columns import canonical, scaled, sha

    return rows.withColumn("row_hash", sha(canonical([
        F.col("strategy"), F.col("session"), scaled("portfolio_value", 6), scaled("benchmark_value", 6)])))


QUERIES = {
    "strategy_signals": signals,
    "long_flat_curve": long_flat_curve,
    "benchmark_curve": benchmark_curve,
    "performance_metrics": performance,
    "period_hit_metrics": period_hits,
    "tail_risk": metric_subset("value_at_risk_95", "expected_shortfall_95"),
    "capture_ratios": metric_subset("upside_capture", "downside_capture"),
    "curve_beta": metric_subset("beta", "alpha"),
    "stage_slices": stage_points,
    "stage_means": stage_means,
    "best_strategy": best_strategy,
    "comparison_gates": comparison_gates,
    "comparison_eligible": comparison_eligible,
    "compare_strategies": compare_strategies,
    "rebalance_schedule": rebalance_schedule,
    "equal_weight_targets": equal_weight,
    "ranked_momentum_targets": ranked_momentum,
    "rebalanced_gross_curve": gross_curve,
    "rebalanced_net_curve": net_curve,
    "warmup_curve": warmup_curve,
    "position_weights": position_weights,
    "weight_check": weight_check,
    "annual_turnover": annual_turnover,
    "window_completeness": window_completeness,
    "universe_sweep": universe_sweep,
    "equal_weight_benchmark_sweep": equal_weight_benchmark_sweep,
    "available_sessions": available_sessions,
    "valuation_series": valuation_series,
}
