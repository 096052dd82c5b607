"""Performance metrics of equity curves, grouped by any keys.

A curve is bounded by the calendar, so one key is one modest window partition; parallelism comes
from the number of curves. Daily figures are computed on one (keys, session) ordering and folded
into a single aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.columns import TRADING_DAYS, ZERO_SPREAD, ratio_or_zero

ROOT = math.sqrt(TRADING_DAYS)
HORIZON = 21
METRICS = (
    "total_return", "annualized_return", "benchmark_total_return", "excess_return", "volatility", "sharpe",
    "sortino", "max_drawdown", "calmar", "tracking_error", "information_ratio", "alpha", "beta",
    "value_at_risk_95", "expected_shortfall_95", "daily_benchmark_win_rate", "upside_capture",
    "downside_capture", "trading_costs", "decision_dates",
)


def spread(column: str) -> Column:
    """Sample deviation, 0.0 for fewer than two values or no variation."""
    value = F.coalesce(F.stddev_samp(column), F.lit(0.0))
    return F.when(value > ZERO_SPREAD, value).otherwise(F.lit(0.0))


def beta_or_zero(values: str, market: str) -> Column:
    slope = F.regr_slope(values, market)
    return F.when((F.count(values) >= 2) & (F.var_pop(market) > ZERO_SPREAD ** 2), slope).otherwise(F.lit(0.0))


def capture(values: str, market: str, side: Column) -> Column:
    return ratio_or_zero(F.avg(F.when(side, F.col(values))), F.avg(F.when(side, F.col(market))))


def _daily(points: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("session")
    seen = order.rowsBetween(W.unboundedPreceding, 0)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    daily = points.select(
        *keys, "session", "equity", "benchmark_equity", "cost",
        (F.row_number().over(order) - 1).alias("i"),
        (F.col("equity") / F.lag("equity").over(order) - 1).alias("gain"),
        (F.col("benchmark_equity") / F.lag("benchmark_equity").over(order) - 1).alias("bench_gain"),
        (F.col("equity") / F.max("equity").over(seen) - 1).alias("drawdown"),
        F.coalesce(F.lead("equity", horizon).over(order), F.last("equity").over(whole)).alias("end_equity"),
        F.coalesce(F.lead("benchmark_equity", horizon).over(order), F.last("benchmark_equity").over(whole))
        .alias("end_benchmark"),
        F.count("*").over(whole).alias("n"),
    )
    worst_first = W.partitionBy(*keys).orderBy(F.asc_nulls_last("gain"))
    return daily.withColumn("active", F.col("gain") - F.col("bench_gain")).withColumn(
        "worst", F.row_number().over(worst_first)).withColumn(
        "tail", F.greatest(F.lit(1), F.ceil((F.col("n") - 1) * 0.05)))


def performance_metrics(points: DataFrame, keys: list[str], horizon: int = HORIZON) -> DataFrame:
    """Twenty risk and return numbers and five holding-period numbers per key.

    ``points`` has the keys and session, equity, benchmark_equity, cost.
    """
    daily = _daily(points, keys, horizon)
    starts = (F.col("i") % horizon == 0) & (F.col("i") < F.col("n") - 1)
    won = F.round(F.col("end_equity") / F.col("equity") - 1, 12)
    bench = F.round(F.col("end_benchmark") / F.col("benchmark_equity") - 1, 12)
    in_tail = F.col("gain").isNotNull() & (F.col("worst") <= F.col("tail"))
    active = F.round("active", 12)
    base = daily.groupBy(*keys).agg(
        F.min_by("equity", "session").alias("e0"), F.max_by("equity", "session").alias("e1"),
        F.min_by("benchmark_equity", "session").alias("b0"), F.max_by("benchmark_equity", "session").alias("b1"),
        F.datediff(F.max("session"), F.min("session")).alias("days"),
        F.count("gain").alias("n_returns"),
        F.coalesce(F.avg("gain"), F.lit(0.0)).alias("mean"), spread("gain").alias("sd"),
        F.coalesce(F.avg("bench_gain"), F.lit(0.0)).alias("bench_mean"),
        F.coalesce(F.avg("active"), F.lit(0.0)).alias("active_mean"), spread("active").alias("active_sd"),
        F.coalesce(F.sqrt(F.avg(F.least(F.col("gain"), F.lit(0.0)) * F.least(F.col("gain"), F.lit(0.0)))), F.lit(0.0))
        .alias("downside"),
        F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"),
        beta_or_zero("gain", "bench_gain").alias("beta"),
        F.coalesce(-F.max(F.when(in_tail, F.col("gain"))), F.lit(0.0)).alias("value_at_risk_95"),
        F.coalesce(-F.avg(F.when(in_tail, F.col("gain"))), F.lit(0.0)).alias("expected_shortfall_95"),
        F.coalesce(F.avg((active > 0).cast("double")), F.lit(0.0)).alias("daily_benchmark_win_rate"),
        capture("gain", "bench_gain", F.col("bench_gain") > 0).alias("upside_capture"),
        capture("gain", "bench_gain", F.col("bench_gain") < 0).alias("downside_capture"),
        F.sum("cost").alias("trading_costs"),
        (F.count("*") - 1).cast("double").alias("decision_dates"),
        F.count_if(starts).cast("double").alias("periods"),
        F.count_if(starts & (won > 0)).cast("double").alias("positive"),
        F.count_if(starts & (won > bench)).cast("double").alias("wins"),
    )
    years = F.greatest(F.col("days") / 365.25, F.lit(1 / TRADING_DAYS))
    named = base.withColumns({
        "total_return": F.col("e1") / F.col("e0") - 1,
        "annualized_return": F.pow(F.col("e1") / F.col("e0"), 1 / years) - 1,
        "benchmark_total_return": F.col("b1") / F.col("b0") - 1,
        "volatility": F.col("sd") * ROOT,
        "sharpe": ratio_or_zero(F.col("mean"), F.col("sd")) * ROOT,
        "sortino": ratio_or_zero(F.col("mean") * TRADING_DAYS, F.col("downside") * ROOT),
        "tracking_error": F.col("active_sd") * ROOT,
        "information_ratio": ratio_or_zero(F.col("active_mean"), F.col("active_sd")) * ROOT,
        "alpha": (F.col("mean") - F.col("beta") * F.col("bench_mean")) * TRADING_DAYS,
    }).withColumns({
        "excess_return": F.col("total_return") - F.col("benchmark_total_return"),
        "calmar": ratio_or_zero(F.col("annualized_return"), F.abs("max_drawdown")),
    })
    return named.select(
        *keys, *METRICS,
        ratio_or_zero(F.col("positive"), F.col("periods")).alias(f"positive_{horizon}_session_rate"),
        ratio_or_zero(F.col("wins"), F.col("periods")).alias(f"benchmark_win_{horizon}_session_rate"),
        F.col("periods").alias(f"evaluated_{horizon}_session_periods"),
        F.col("positive").alias(f"positive_{horizon}_session_periods"),
        F.col("wins").alias(f"benchmark_wins_{horizon}_session_periods"),
    )


def metric_names(horizon: int = HORIZON) -> tuple[str, ...]:
    return METRICS + (
        f"positive_{horizon}_session_rate", f"benchmark_win_{horizon}_session_rate",
        f"evaluated_{horizon}_session_periods", f"positive_{horizon}_session_periods",
        f"benchmark_wins_{horizon}_session_periods",
    )


def period_hit_metrics(points: DataFrame, keys: list[str], horizon: int = HORIZON) -> DataFrame:
    """Outcomes of non-overlapping holding periods; the last, shorter period counts."""
    return performance_metrics(points, keys, horizon).select(*keys, *metric_names(horizon)[len(METRICS):])


def annual_turnover(points: DataFrame, keys: list[str]) -> DataFrame:
    years = F.greatest(F.datediff(F.max("session"), F.min("session")) / 365.25, F.lit(1 / TRADING_DAYS))
    return points.groupBy(*keys).agg((F.sum("turnover") / years).alias("annual_turnover"))
