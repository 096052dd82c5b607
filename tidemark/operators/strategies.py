"""Cross-sectional selections: targets per decision as long tables (strategy, decision, symbol, weight).

Ranking windows are partitioned by decision, so a partition holds at most one row per listed symbol.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.features import total_return, with_growth

EQUAL_WEIGHT = "equal_weight"


def momentum_name(lookback: int, top_n: int) -> str:
    return f"ranked_momentum_{lookback}d_top{top_n}"


def equal_weights(selected: DataFrame, keys: Sequence[str] = ("strategy", "decision")) -> DataFrame:
    """1/n for the rows selected at each decision."""
    return selected.withColumn("weight", F.lit(1.0) / F.count("*").over(W.partitionBy(*keys)))


def decision_panel(bars: DataFrame, schedule: DataFrame, lookbacks: Sequence[int]) -> DataFrame:
    """Momentum of every lookback at the decision sessions; windows see all earlier bars."""
    momentum = [(total_return(k) - 1).alias(f"momentum_{k}") for k in lookbacks]
    panel = with_growth(bars).select("symbol", "session", *momentum)
    decisions = schedule.filter("decides").select(F.col("session").alias("decision"))
    return panel.join(F.broadcast(decisions), panel.session == F.col("decision")).drop("session")


def equal_weight_targets(panel: DataFrame) -> DataFrame:
    return equal_weights(panel.select(F.lit(EQUAL_WEIGHT).alias("strategy"), "decision", "symbol"))


def ranked_momentum_targets(panel: DataFrame, lookbacks: Sequence[int], top_n: int) -> DataFrame:
    """Largest positive total-return momentum first, symbol as tie-break, first ``top_n``."""
    pairs = F.array(*[
        F.struct(F.lit(momentum_name(k, top_n)).alias("strategy"), F.col(f"momentum_{k}").alias("momentum"))
        for k in lookbacks])
    rows = panel.select("decision", "symbol", F.explode(pairs).alias("pair")).select(
        "pair.strategy", "decision", "symbol", "pair.momentum").filter("momentum > 0")
    position = F.row_number().over(W.partitionBy("strategy", "decision").orderBy(F.desc("momentum"), "symbol"))
    return equal_weights(rows.withColumn("position", position).filter(F.col("position") <= top_n))


def composite_ranking(packet: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Deterministic ranking: mid momenta rewarded, volatility penalised; id breaks ties."""
    score = F.round(F.col("momentum_63") + F.col("momentum_126") - 0.25 * F.col("volatility_63"), 12)
    scored = packet.withColumn("score", score)
    return scored.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "id")))


def normalize_rankings(responses: DataFrame, ranked: DataFrame, size: int = 20) -> DataFrame:
    """Outside rankings made whole: known ids only, first mention counts, padded from our ranking.

    ``responses`` has (decision, ranked_ids array), ``ranked`` (decision, id, position).
    """
    named = responses.select("decision", F.posexplode("ranked_ids").alias("place", "id")).groupBy(
        "decision", "id").agg(F.min("place").alias("place"))
    known = named.join(ranked.select("decision", "id"), ["decision", "id"], "left_semi").select(
        "decision", "id", F.lit(0).alias("source"), F.col("place").cast("bigint").alias("place"))
    asked = ranked.join(responses.select("decision").distinct(), "decision", "left_semi")
    padding = asked.join(known, ["decision", "id"], "left_anti").select(
        "decision", "id", F.lit(1).alias("source"), F.col("position").cast("bigint").alias("place"))
    order = W.partitionBy("decision").orderBy("source", "place")
    ranks = known.unionByName(padding).withColumn("position", F.row_number().over(order))
    valid = F.count_if(F.col("source") == 0).over(W.partitionBy("decision"))
    return ranks.withColumn("valid_count", valid).filter(
        (F.col("position") <= F.greatest(F.lit(size), F.col("valid_count")))
        & ((F.col("source") == 0) | (F.col("position") <= size))
    ).select("decision", "id", "position", F.when(F.col("source") == 0, "ranker").otherwise("fallback").alias("source"))


def ranking_targets(
    rankings: DataFrame, aliases: DataFrame, top_n: int = 20, strategy: str = "anonymous_ranking",
) -> DataFrame:
    """First ``top_n`` ranked ids as an equal-weight portfolio; none where too few assets exist."""
    enough = aliases.groupBy("decision").agg(F.count("*").alias("assets")).filter(F.col("assets") >= top_n)
    chosen = rankings.filter(F.col("position") <= top_n).join(enough, "decision", "left_semi").join(
        aliases.select("decision", "id", "symbol"), ["decision", "id"])
    return equal_weights(chosen.select(F.lit(strategy).alias("strategy"), "decision", "symbol", "position"))


def unknown_ids(rankings: DataFrame, aliases: DataFrame) -> DataFrame:
    return rankings.join(aliases.select("decision", "id"), ["decision", "id"], "left_anti")


def gated_targets(
    ranked: DataFrame, approvals: DataFrame, shortlist: int = 40, top_n: int = 20,
    strategy: str = "gated_ranking",
) -> DataFrame:
    """Shortlist by base order, keep approved names (no review is no approval), first ``top_n``.

    ``ranked`` has (decision, symbol, position), ``approvals`` (decision, symbol, approved).
    """
    approved = approvals.groupBy("decision", "symbol").agg(F.bool_and("approved").alias("approved")).filter("approved")
    kept = ranked.filter(F.col("position") <= shortlist).join(approved, ["decision", "symbol"], "left_semi")
    again = F.row_number().over(W.partitionBy("decision").orderBy("position"))
    selected = kept.withColumn("place", again).filter(F.col("place") <= top_n)
    return equal_weights(selected.select(F.lit(strategy).alias("strategy"), "decision", "symbol", "place"))


def stage_table(spark, boundaries: Sequence[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(list(boundaries), "stage string, start_i int, end_i int")


def stages(points: DataFrame, warmup: int = 0, minimum: tuple[int, int] = (0, 0)) -> DataFrame:
    """Index boundaries at 60 and 80 percent of the shortest curve; stages share one point.

    ``points`` has (keys, i) numbered from 0. ``minimum`` holds the least development length and the
    least validation length. One row per stage: the table is tiny and is broadcast.
    """
    curves = [c for c in ("symbol", "candidate", "strategy") if c in points.columns]
    shortest = points.groupBy(*curves).agg(F.count("*").alias("n")).agg(F.min("n").alias("n"))
    n = F.col("n") - warmup
    cut = shortest.withColumn(
        "development_end", warmup + F.greatest(F.lit(minimum[0]), F.floor(n * 0.6))).withColumn(
        "validation_end", F.greatest(F.col("development_end") + minimum[1], warmup + F.floor(n * 0.8)))
    rows = F.array(
        _stage("development", F.lit(warmup), F.col("development_end")),
        _stage("validation", F.col("development_end") - 1, F.col("validation_end")),
        _stage("holdout", F.col("validation_end") - 1, F.col("n")),
    )
    return cut.select(F.explode(rows).alias("stage")).select("stage.*")


def _stage(name: str, start, end):
    return F.struct(
        F.lit(name).alias("stage"), start.cast("bigint").alias("start_i"), end.cast("bigint").alias("end_i"))


def slice_stages(points: DataFrame, stage_rows: DataFrame) -> DataFrame:
    """Curve points repeated per stage they belong to (a shared boundary point belongs to two)."""
    bounds = stage_rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("start_i", "end_i", "stage"))).alias("all"))
    inside = F.filter("all", lambda s: (F.col("i") >= s["start_i"]) & (F.col("i") < s["end_i"]))
    kept = points.columns
    return points.withColumn("all", bounds.scalar()).select(
        *kept, F.explode(inside).alias("slot")).select(*kept, "slot.stage")


def stage_means(metrics: DataFrame, keys: Sequence[str] = ("candidate", "stage")) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.avg("information_ratio").alias("mean_information_ratio"),
        F.avg("excess_return").alias("mean_excess_return"),
        F.avg("sharpe").alias("mean_sharpe"),
        F.min("max_drawdown").alias("worst_drawdown"),
        F.min("decision_dates").alias("decision_dates"),
    )


def selected_by(name: str, eligible: Column, *scores: str) -> Column:
    """The name with the largest scores among eligible rows; on a full tie the largest name.

    A window over the whole result, which holds one row per candidate and stage.
    """
    order = F.struct(*[F.round(score, 12) for score in scores], F.col(name))
    return F.max(F.when(eligible, order)).over(W.partitionBy())[name]


def required_symbols(spans: DataFrame, records: DataFrame, start: str, end: str) -> DataFrame:
    """Symbols listed by a record inside the range, and members as of its start."""
    low, high = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    dated = records.filter(F.col("date").between(low, high)).select("symbol")
    current = spans.filter((F.col("valid_from") <= low) & (
        F.col("valid_to").isNull() | (F.col("valid_to") > low))).select("symbol")
    return dated.union(current).distinct()


def download_worklist(required: DataFrame, cached: DataFrame) -> DataFrame:
    return required.join(cached.select("symbol").distinct(), "symbol", "left_anti")


def worklist_counts(required: DataFrame, cached: DataFrame) -> DataFrame:
    held = cached.select("symbol").distinct().withColumn("cached", F.lit(True))
    return required.join(held, "symbol", "left").agg(
        F.count("*").alias("required"), F.count_if("cached").alias("cached"),
        (F.count("*") - F.count_if("cached")).alias("remaining"))
