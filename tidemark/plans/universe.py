"""Dynamic-membership curve: only members may be chosen, and every member must be priced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, curves
from tidemark.plans.compare import sweep_targets
from tidemark.session import materialize


class CoverageError(ValueError):
    """A member lacks a price inside the period."""


def point_in_time_curve(
    bars: DataFrame, benchmark: DataFrame, members: DataFrame, lookbacks: Sequence[int], top_n: int,
    every: int = 21, cost_bps: float = 5.0,
) -> DataFrame:
    """Net curves of equal weight and ranked momentum over the members of each decision date.

    Sessions are the benchmark's. Fails when a member has no bar on some session, or when a holding
    loses its price before the next rebalance.
    """
    sessions = materialize(benchmark.select("session").distinct())
    audit = asof.coverage_audit(sessions, members, bars).first()
    if not audit["approved"]:
        sample = asof.missing_prices(sessions, members, bars).limit(3).collect()
        named = ", ".join(f"{row['session']}:{row['symbol']}" for row in sample)
        raise CoverageError(f"price coverage is {audit['coverage']:.2%}; missing {named}")
    schedule = materialize(curves.rebalance_calendar(sessions, every))
    panel = bars.join(F.broadcast(sessions), "session", "left_semi")
    eligible = asof.members_on(
        schedule.filter("decides").select(F.col("session").alias("as_of")), members,
    ).select(F.col("as_of").alias("session"), "symbol")
    targets, names = sweep_targets(bars, schedule, lookbacks, top_n, eligible)
    targets = materialize(targets)
    gaps = curves.uncovered_holdings(panel, schedule, targets)
    if not gaps.isEmpty():
        raise CoverageError(f"holdings lack prices, e.g. {gaps.first().asDict()}")
    return curves.rebalanced_curve(panel, benchmark, schedule, targets, names, cost_bps)
