"""Policy gates as check tables: one row per subject and named check."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import check_rows


@dataclass(frozen=True)
class PromotionPolicy:
    # Default thresholds.
    minimum_independent_dates: int = 60
    minimum_rank_correlation: float = 0.02
    minimum_information_ratio: float = 0.0
    maximum_drawdown: float = -0.25
    maximum_turnover: float = 12.0


def _long(rows: DataFrame, keys: Sequence[str], checks) -> DataFrame:
    return rows.select(*keys, F.explode(checks).alias("gate")).select(*keys, "gate.check", "gate.passed")


def promotion_checks(metrics: DataFrame, keys: Sequence[str], policy: PromotionPolicy = PromotionPolicy()) -> DataFrame:
    """Six gates over a metrics table; a missing (null) metric fails its gate."""
    return _long(metrics, keys, check_rows({
        "independent_dates": F.coalesce("independent_dates", F.lit(0)) >= policy.minimum_independent_dates,
        "rank_correlation": F.col("rank_correlation") >= policy.minimum_rank_correlation,
        "information_ratio": F.col("information_ratio") >= policy.minimum_information_ratio,
        "maximum_drawdown": F.col("max_drawdown") >= policy.maximum_drawdown,
        "turnover": F.col("annual_turnover") <= policy.maximum_turnover,
        "holdout_opened": F.col("holdout_opened") != 0,
    }))


def comparison_gates(
    stage_rows: DataFrame, minimum_stage_dates: int = 60, maximum_drawdown: float = -0.25,
    survivorship_safe: bool = False, keys: Sequence[str] = ("candidate",),
) -> DataFrame:
    """Ten gates per candidate from its stage means, and whether all hold."""
    def at(stage: str, metric: str):
        return F.max(F.when(F.col("stage") == stage, F.col(metric)))

    wide = stage_rows.groupBy(*keys).agg(
        at("development", "mean_excess_return").alias("dev_excess"),
        at("validation", "mean_excess_return").alias("val_excess"),
        at("validation", "mean_information_ratio").alias("val_ir"),
        at("holdout", "mean_excess_return").alias("hold_excess"),
        at("holdout", "mean_information_ratio").alias("hold_ir"),
        at("validation", "decision_dates").alias("val_dates"),
        at("holdout", "decision_dates").alias("hold_dates"),
        at("validation", "worst_drawdown").alias("val_drawdown"),
        at("holdout", "worst_drawdown").alias("hold_drawdown"),
    )
    return _long(wide, keys, check_rows({
        "development_excess_positive": F.col("dev_excess") > 0,
        "validation_excess_positive": F.col("val_excess") > 0,
        "validation_information_ratio_positive": F.col("val_ir") > 0,
        "holdout_excess_positive": F.col("hold_excess") > 0,
        "holdout_information_ratio_positive": F.col("hold_ir") > 0,
        "minimum_validation_dates": F.col("val_dates") >= minimum_stage_dates,
        "minimum_holdout_dates": F.col("hold_dates") >= minimum_stage_dates,
        "validation_drawdown_within_limit": F.col("val_drawdown") >= maximum_drawdown,
        "holdout_drawdown_within_limit": F.col("hold_drawdown") >= maximum_drawdown,
        "survivorship_safe_universe": F.lit(survivorship_safe),
    }))


def all_pass(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return checks.groupBy(*keys).agg(F.bool_and("passed").alias("approved"))
