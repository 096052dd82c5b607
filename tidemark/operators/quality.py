"""Row rules: validity of bars, orders, quotes, fills and reports, each as a list of broken rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import violations


def bar_violations() -> Column:
    positive = {f"{name}_positive": F.col(name) > 0 for name in ("open", "high", "low", "close")}
    return violations({
        **positive,
        "adjusted_close_positive": F.col("adjusted_close") > 0,
        "volume_not_negative": F.col("volume") >= 0,
        "dividend_not_negative": F.col("dividend") >= 0,
        "split_positive": F.col("split_coefficient") > 0,
        "low_is_lowest": F.col("low") <= F.least("open", "close"),
        "high_is_highest": F.col("high") >= F.greatest("open", "close"),
        "published_before_available": F.col("published_at") <= F.col("available_to_strategy_at"),
        "known_quality": F.col("quality").isin(*schemas.QUALITY),
    })


def order_violations() -> Column:
    return violations({
        "quantity_positive": F.col("quantity") > 0,
        "reference_price_positive": F.col("reference_price") > 0,
        "weight_in_range": (F.col("max_position_weight") > 0) & (F.col("max_position_weight") <= 1),
        "executes_after_submission": F.col("earliest_execution_at") > F.col("submitted_at"),
        "known_side": F.col("side").isin(*schemas.SIDES),
    })


def quote_violations() -> Column:
    return violations({
        "mid_positive": F.col("mid") > 0,
        "spread_not_negative": F.col("spread_bps") >= 0,
        "available_quantity_not_negative": F.col("available_quantity") >= 0,
    })


def fill_violations() -> Column:
    return violations({
        "quantity_positive": F.col("quantity") > 0,
        "price_positive": F.col("price") > 0,
        "spread_cost_not_negative": F.col("spread_cost") >= 0,
        "slippage_cost_not_negative": F.col("slippage_cost") >= 0,
        "fee_not_negative": F.col("fee") >= 0,
    })


def _length_between(column: Column, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


def finding_violations(finding: str = "finding") -> Column:
    part = lambda name: F.col(f"{finding}.{name}")
    return violations({
        "topic_length": _length_between(part("topic"), 1, 100),
        "claim_length": _length_between(part("factual_claim"), 1, 500),
        "interpretation_length": _length_between(part("interpretation"), 1, 500),
        "uncertainty_length": _length_between(part("uncertainty_notes"), 1, 300),
        "cites_evidence": F.size(part("evidence_ids")) >= 1,
        "known_stance": part("stance").isin(*schemas.STANCES),
        "known_severity": part("severity").isin(*schemas.SEVERITIES),
    })


def report_violations() -> Column:
    return violations({
        "report_identity": F.length(F.col("report_id").cast("string")) > 0,
        "prompt_version": F.length("prompt_version") > 0,
        "known_role": F.col("role").isin(*schemas.ROLES),
    })


def synthesis_violations() -> Column:
    return violations({
        "summary_length": _length_between(F.col("summary"), 1, 700),
        "names_reports": F.size("report_ids") >= 1,
        "names_evidence": F.size("evidence_ids") >= 1,
        "known_verdict": F.col("verdict").isin(*schemas.VERDICTS),
    })


def split_valid(rows: DataFrame, broken: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with the names of the rules they break)."""
    checked = rows.withColumn("violations", broken)
    return (
        checked.filter(F.size("violations") == 0).drop("violations"),
        checked.filter(F.size("violations") > 0),
    )


def duplicate_sessions(bars: DataFrame) -> DataFrame:
    """(symbol, session) pairs that occur more than once; a clean panel returns no rows."""
    return bars.groupBy("symbol", "session").agg(F.count("*").alias("copies")).filter("copies > 1")


def eligible(rows: DataFrame, decision_at: Column) -> DataFrame:
    """Rows a decision may see: available by then and of passing quality."""
    return rows.filter((F.col("available_to_strategy_at") <= decision_at) & (F.col("quality") == "PASS"))


def date_slice(bars: DataFrame, start: str, end: str, minimum: int = 2) -> DataFrame:
    """Bars kept per symbol inside a date range, with a flag where fewer than ``minimum`` remain."""
    inside = F.col("session").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return bars.groupBy("symbol").agg(
        F.count_if(inside).alias("kept"),
        F.min(F.when(inside, F.col("session"))).alias("first_session"),
        F.max(F.when(inside, F.col("session"))).alias("last_session"),
    ).withColumn("sufficient", F.col("kept") >= minimum)


def weight_violations(weights: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Per decision: long-only and at most fully funded."""
    return weights.groupBy(*keys).agg(
        F.min("weight").alias("lowest"), F.sum("weight").alias("total")
    ).withColumn("valid", (F.col("lowest") >= 0) & (F.col("total") <= 1 + tolerance))


def confinement_violations(rows: DataFrame, folds: DataFrame, development_end: str) -> DataFrame:
    """Training rows and fold dates that reach beyond the development period."""
    end = F.to_date(F.lit(development_end))
    decisions = rows.groupBy().agg(
        F.count_if(F.col("decision_date") > end).alias("late"), F.max("decision_date").alias("latest"))
    labels = rows.groupBy().agg(
        F.count_if(F.col("label_end_date") > end).alias("late"), F.max("label_end_date").alias("latest"))
    dates = folds.groupBy().agg(F.count_if(F.col("date") > end).alias("late"), F.max("date").alias("latest"))
    return (
        decisions.withColumn("scope", F.lit("decision_date"))
        .unionByName(labels.withColumn("scope", F.lit("label_end_date")))
        .unionByName(dates.withColumn("scope", F.lit("fold_date")))
        .withColumn("confined", F.col("late") == 0)
    )
