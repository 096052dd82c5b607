"""Strategy comparison: every symbol x candidate x stage in one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import curves, strategies
from tidemark.operators.metrics import performance_metrics
from tidemark.session import materialize

MINIMUM_STAGES = (30, 15)


def lookback_summary(
    bars: DataFrame, benchmark: DataFrame, lookbacks: Sequence[int], cost_bps: float = 5.0,
) -> DataFrame:
    """Metrics of every candidate traded at the next open, averaged over symbols, best first."""
    points = curves.long_flat_curves(bars, benchmark, lookbacks, cost_bps)
    metrics = performance_metrics(points, ["symbol", "candidate"])
    return metrics.groupBy("candidate").agg(
        F.count("*").alias("symbols"),
        F.round(F.avg("information_ratio"), 6).alias("mean_information_ratio"),
        F.round(F.avg("excess_return"), 6).alias("mean_excess_return"),
        F.round(F.avg("sharpe"), 6).alias("mean_sharpe"),
        F.round(F.min("max_drawdown"), 6).alias("worst_drawdown"),
        F.round(F.max("information_ratio"), 6).alias("best_information_ratio"),
        F.max_by("symbol", F.struct(F.round("information_ratio", 12), "symbol")).alias("best_symbol"),
    )


def staged_metrics(points: DataFrame, keys: list[str], warmup: int = 0, minimum=MINIMUM_STAGES) -> DataFrame:
    staged = strategies.slice_stages(points, strategies.stages(points, warmup, minimum))
    return performance_metrics(staged, [*keys, "stage"])


def compare_candidates(
    bars: DataFrame, benchmark: DataFrame, lookbacks: Sequence[int], cost_bps: float = 5.0,
) -> DataFrame:
    """Stage means per candidate, with the candidate chosen on development data marked."""
    points = curves.long_flat_curves(bars, benchmark, lookbacks, cost_bps).filter(
        F.col("candidate") != curves.CASH)
    means = strategies.stage_means(staged_metrics(points, ["symbol", "candidate"]))
    chosen = strategies.selected_by(
        "candidate", F.col("stage") == "development", "mean_information_ratio", "mean_excess_return")
    return means.withColumn("selected", F.col("candidate") == chosen)


def sweep_targets(
    panel: DataFrame, schedule: DataFrame, lookbacks: Sequence[int], top_n: int,
    eligible: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """Equal weight and one ranked-momentum portfolio per lookback, keyed by strategy.

    ``eligible`` (session, symbol) limits the choice at each decision; histories stay whole.
    """
    decisions = strategies.decision_panel(panel, schedule, lookbacks)
    if eligible is not None:
        decisions = decisions.join(
            eligible.select(F.col("session").alias("decision"), "symbol"), ["decision", "symbol"], "left_semi")
    columns = ["strategy", "decision", "symbol", "weight"]
    targets = strategies.equal_weight_targets(decisions).select(*columns).unionByName(
        strategies.ranked_momentum_targets(decisions, lookbacks, top_n).select(*columns))
    names = [strategies.EQUAL_WEIGHT] + [strategies.momentum_name(k, top_n) for k in lookbacks]
    return targets, names


def universe_sweep(
    bars: DataFrame, benchmark: DataFrame, lookbacks: Sequence[int] = (21, 63, 126, 252), top_n: int = 20,
    every: int = 21, warmup: int = 253, cost_bps: float = 5.0, benchmark_label: str = "index",
    extra_targets: DataFrame | None = None, extra_names: Sequence[str] = (),
) -> DataFrame:
    """All strategies of a fixed universe: curves on the common sessions, staged after the warm-up.

    With ``benchmark_label='equal_weight'`` the equal-weight curve stands in for the benchmark.
    """
    sessions = materialize(curves.common_sessions(bars, benchmark))
    panel = bars.join(F.broadcast(sessions), "session", "left_semi")
    schedule = curves.rebalance_calendar(sessions, every)
    targets, names = sweep_targets(panel, schedule, lookbacks, top_n)
    if extra_targets is not None:
        targets = targets.unionByName(extra_targets.select("strategy", "decision", "symbol", "weight"))
        names = [*names, *extra_names]
    points = materialize(curves.rebalanced_curve(panel, benchmark, schedule, targets, names, cost_bps))
    if benchmark_label == strategies.EQUAL_WEIGHT:
        base = points.filter(F.col("strategy") == strategies.EQUAL_WEIGHT).select(
            "session", F.col("equity").alias("benchmark_equity"))
        points = points.drop("benchmark_equity").join(F.broadcast(base), "session")
    staged = staged_metrics(points, ["strategy"], warmup, (0, 0))
    full = performance_metrics(points.filter(F.col("i") >= warmup), ["strategy"]).withColumn(
        "stage", F.lit("full_period"))
    return staged.unionByName(full)
