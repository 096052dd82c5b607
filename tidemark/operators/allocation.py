"""Constrained target weights for many portfolios at once, keyed by decision."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.columns import check_rows, violations
from tidemark.operators.features import FEATURES
from tidemark.operators.modeling import score


@dataclass(frozen=True)
class Constraints:
    # Default limits.
    maximum_position_weight: float = 0.10
    maximum_sector_weight: float = 0.25
    maximum_turnover: float = 0.30
    minimum_excess_return: float = 0.01
    maximum_uncertainty: float = 0.15
    minimum_evidence_completeness: float = 0.80
    minimum_average_dollar_volume: float = 5_000_000
    maximum_invested_weight: float = 1.0

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if name.endswith(("_weight", "_turnover")) and not 0 <= value <= 1:
                raise ValueError(f"{name} is a share of the portfolio, not {value}")
        if self.maximum_sector_weight < self.maximum_position_weight:
            raise ValueError(f"a sector of {self.maximum_sector_weight} has no room for a position of {self.maximum_position_weight}")


def gate_columns(c: Constraints) -> dict[str, Column]:
    return {
        "approved": F.col("approved"),
        "expected_excess_return": F.col("expected_excess_return") >= c.minimum_excess_return,
        "uncertainty": (F.col("uncertainty") >= 0) & (F.col("uncertainty") <= c.maximum_uncertainty),
        "evidence_completeness": F.col("evidence_completeness") >= c.minimum_evidence_completeness,
        "liquidity": F.col("average_dollar_volume") >= c.minimum_average_dollar_volume,
    }


def candidate_checks(candidates: DataFrame, constraints: Constraints, keys: Sequence[str] = ("decision",)) -> DataFrame:
    return candidates.select(*keys, "symbol", F.explode(check_rows(gate_columns(constraints))).alias("gate")).select(
        *keys, "symbol", "gate.check", "gate.passed")


def desired_weights(candidates: DataFrame, c: Constraints, key: str = "decision") -> DataFrame:
    """Greedy capped weights without a loop, on one exchange by decision.

    In score order a name first gets what its sector still allows, which depends only on its rank in
    the sector; then the invested cap cuts the running total. Partitions are one decision's names.
    """
    passed = None
    for gate in gate_columns(c).values():
        ok = F.coalesce(gate, F.lit(False))
        passed = ok if passed is None else passed & ok
    risk = F.greatest("uncertainty", F.lit(1e-6))
    scored = candidates.filter(passed).withColumn(
        "score", F.col("expected_excess_return") / risk).repartition(key)
    best = [F.desc("score"), F.col("symbol")]
    rank = F.row_number().over(W.partitionBy(key, "sector").orderBy(*best))
    room = F.lit(c.maximum_sector_weight) - F.lit(c.maximum_position_weight) * (F.col("sector_rank") - 1)
    before = W.partitionBy(key).orderBy(*best).rowsBetween(W.unboundedPreceding, -1)
    return scored.withColumn("sector_rank", rank).withColumn(
        "allowed", F.greatest(F.lit(0.0), F.least(room, F.lit(c.maximum_position_weight)))).withColumn(
        "used", F.coalesce(F.sum("allowed").over(before), F.lit(0.0))).withColumn(
        "weight", F.greatest(F.lit(0.0), F.least(F.lit(c.maximum_invested_weight) - F.col("used"), F.col("allowed")))
    ).filter("weight > 0").select(key, "symbol", "sector", "score", "weight")


def turnover_capped(desired: DataFrame, current: DataFrame, c: Constraints, key: str = "decision") -> DataFrame:
    """Move from current to desired weights by at most the turnover limit; cash is the rest.

    The two portfolios are stacked and summed rather than joined: one exchange by decision serves the
    sum and the totals.
    """
    none = F.lit(0.0)
    both = desired.select(key, "symbol", F.col("weight").alias("desired"), none.alias("current")).unionByName(
        current.select(key, "symbol", none.alias("desired"), F.col("weight").alias("current"))).repartition(
        key).groupBy(key, "symbol").agg(F.sum("desired").alias("desired"), F.sum("current").alias("current"))
    per_key = W.partitionBy(key)
    raw = F.sum(F.abs(F.col("desired") - F.col("current"))).over(per_key)
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(c.maximum_turnover), raw), F.lit(1.0)))
    moved = both.withColumn("target", F.col("current") + scale * (F.col("desired") - F.col("current")))
    kept = F.when(F.col("target") > 1e-12, F.col("target")).otherwise(F.lit(0.0))
    return moved.withColumn("target", kept).select(
        key, "symbol", "current", "desired", F.col("target").alias("weight"),
        F.sum(F.abs(F.col("target") - F.col("current"))).over(per_key).alias("turnover"),
        F.greatest(F.lit(0.0), 1 - F.sum("target").over(per_key)).alias("cash_weight"))


def sector_weights(current: DataFrame, candidates: DataFrame, c: Constraints, key: str = "decision") -> DataFrame:
    sectors = candidates.select(key, "symbol", "sector")
    return current.join(sectors, [key, "symbol"]).groupBy(key, "sector").agg(F.sum("weight").alias("weight")).withColumn(
        "within_limit", F.col("weight") <= c.maximum_sector_weight)


def portfolio_violations(current: DataFrame, candidates: DataFrame, c: Constraints, key: str = "decision") -> DataFrame:
    """Broken rules of each current portfolio; portfolios without any give no row."""
    known = candidates.groupBy(key, "symbol").agg(F.count("*").alias("copies"), F.min("sector").alias("sector"))
    repeated = known.groupBy(key).agg(F.max("copies").alias("copies"))
    rows = current.join(known.drop("copies"), [key, "symbol"], "left")
    by_sector = rows.filter("sector IS NOT NULL").groupBy(key, "sector").agg(F.sum("weight").alias("weight")).groupBy(
        key).agg(F.max("weight").alias("largest_sector"))
    totals = rows.groupBy(key).agg(
        F.min("weight").alias("lowest"), F.max("weight").alias("highest"), F.sum("weight").alias("total"),
        F.count_if(F.col("sector").isNull()).alias("unknown"))
    checked = totals.join(by_sector, key, "left").join(repeated, key, "left").withColumn("violations", violations({
        "unique_candidates": F.coalesce("copies", F.lit(1)) <= 1,
        "holdings_have_metadata": F.col("unknown") == 0,
        "position_weights": (F.col("lowest") >= 0) & (F.col("highest") <= c.maximum_position_weight),
        "sector_weights": F.coalesce("largest_sector", F.lit(0.0)) <= c.maximum_sector_weight,
        "fully_funded": F.col("total") <= 1,
    }))
    return checked.filter(F.size("violations") > 0).select(key, "violations")


def version_mismatches(snapshots: DataFrame, feature_version: str) -> DataFrame:
    return snapshots.filter(F.col("feature_version") != feature_version)


def scored_candidates(
    snapshots: DataFrame, model: DataFrame, context: DataFrame, residual_uncertainty: float,
    feature_version: str, features: Sequence[str] = FEATURES, key: str = "decision",
) -> DataFrame:
    """Model scores as allocation candidates. Snapshots of another version or with a missing feature
    are left out here and listed by ``version_mismatches`` and ``unscorable``.

    A model table with the ``key`` column scores each decision by its own model; without it there must
    be exactly one model."""
    if not residual_uncertainty >= 0:
        raise ValueError(f"uncertainty of residuals is a deviation, not {residual_uncertainty}")
    usable = snapshots.filter(F.col("feature_version") == feature_version)
    if key in model.columns:
        joined = usable.join(model, key)
    else:
        models = model.limit(2).count()
        if models != 1:
            raise ValueError(f"{'several' if models else 'no'} models and no column {key} to choose by")
        joined = usable.withColumn("one", F.lit(1)).join(F.broadcast(model.withColumn("one", F.lit(1))), "one")
    scored = joined.select(key, "symbol", score(features).alias("expected_excess_return")).filter(
        "expected_excess_return IS NOT NULL")
    return scored.join(context, [key, "symbol"]).withColumn("uncertainty", F.lit(residual_uncertainty))


def unscorable(snapshots: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in features]))
    return snapshots.withColumn("missing", missing).filter(F.size("missing") > 0)


def allocate(candidates: DataFrame, current: DataFrame, c: Constraints, key: str = "decision") -> DataFrame:
    return turnover_capped(desired_weights(candidates, c, key), current, c, key)
