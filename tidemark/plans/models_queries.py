"""Registered queries: labels, folds, ridge models, evaluation, allocation and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import joined, r
from tidemark.operators import allocation, features, gates, metrics, modeling, quality
from tidemark.plans import driver_tables as d
from tidemark.plans.curves_queries import COST, panel, rebalanced
from tidemark.session import materialize

HORIZON, CUTOFF = 4, "2001-06-30"
FOLDS = (30, 10, 4, 2)
ALPHAS = (0.1, 1.0, 10.0, 100.0)
PAIR = ("momentum_21d", "realized_volatility_21d")
LIMITS = allocation.Constraints(
    minimum_evidence_completeness=0.985, minimum_average_dollar_volume=8_000, maximum_turnover=0.5)


def snapshots(spark, sf):
    bars, bench = panel(spark, sf)
    return features.feature_panel(bars, bench), bars, bench


def rows(spark, sf):
    """Training rows, written once: folds, moments and predictions all read them."""
    shots, bars, bench = snapshots(spark, sf)
    return materialize(modeling.training_rows(shots, bars, bench, HORIZON, CUTOFF))


def dates_of(training):
    return training.select(F.col("decision_date").alias("date")).distinct()


def places_of(training):
    return materialize(modeling.fold_places(dates_of(training), *FOLDS))


def training_rows(spark, sf):
    shots, bars, bench = snapshots(spark, sf)
    return modeling.training_rows(shots, bars, bench, HORIZON, CUTOFF).select(
        "symbol", "decision_date", "label_end_date", r("momentum_63d").alias("momentum_63d"),
        *[r(c).alias(c) for c in ("forward_return", "benchmark_forward_return", "excess_return")])


def demeaned_labels(spark, sf):
    shots, bars, bench = snapshots(spark, sf)
    return modeling.demeaned(modeling.training_rows(shots, bars, bench, HORIZON, CUTOFF)).select(
        "symbol", "decision_date", r("target").alias("target"))


def label_gaps(spark, sf):
    shots, bars, bench = snapshots(spark, sf)
    return modeling.label_gaps(modeling.training_rows(shots, bars, bench, HORIZON, CUTOFF), shots).groupBy(
        "symbol").agg(F.count("*").alias("gaps"))


def walk_forward_folds(spark, sf):
    return modeling.purged_walk_forward(dates_of(rows(spark, sf)), *FOLDS)


def fold_leakage(spark, sf):
    training = rows(spark, sf)
    return modeling.fold_leakage(training, modeling.purged_walk_forward(dates_of(training), 30, 10, 3, 2))


def confinement(spark, sf):
    training = rows(spark, sf)
    folds = modeling.purged_walk_forward(dates_of(training), *FOLDS)
    return quality.confinement_violations(training, folds, "2001-03-31").select("scope", "late", "latest", "confined")


def correlation_moments(spark, sf):
    """Standardised second moments per fold, from the cumulated sums."""
    training = rows(spark, sf)
    sums = modeling.fold_moments(training, places_of(training))
    names = features.FEATURES
    mean = [F.col(f"sx_{k}") / F.col("n") for k in range(len(names))]
    sd = [F.sqrt(F.col(f"sxx_{k}_{k}") / F.col("n") - mean[k] * mean[k]) for k in range(len(names))]
    entries = [
        F.struct(F.lit(names[a]).alias("left"), F.lit(names[b]).alias("right"),
                 ((F.col(f"sxx_{a}_{b}") / F.col("n") - mean[a] * mean[b]) / (sd[a] * sd[b])).alias("value"))
        for a in range(len(names)) for b in range(a, len(names))
    ] + [
        F.struct(F.lit(names[a]).alias("left"), F.lit("target").alias("right"),
                 ((F.col(f"sxy_{a}") - mean[a] * F.col("sy")) / F.col("n") / sd[a]).alias("value"))
        for a in range(len(names))]
    return sums.select("fold", "n", F.explode(F.array(*entries)).alias("e")).select(
        "fold", "n", "e.left", "e.right", r("e.value", 5).alias("value"))


def ridge_models(spark, sf):
    training = rows(spark, sf)
    models = modeling.ridge_models(modeling.fold_factors(training, places_of(training), PAIR), ALPHAS, PAIR)
    return models.select(
        "fold", "alpha", r("intercept").alias("intercept"), "training_rows", "training_end",
        *[r(F.col("coefficients")[k], 7).alias(f"coefficient_{k}") for k in range(2)],
        *[r(F.col("means")[k]).alias(f"mean_{k}") for k in range(2)],
        *[r(F.col("scales")[k]).alias(f"scale_{k}") for k in range(2)])


def ridge_models_all(spark, sf):
    training = rows(spark, sf)
    models = modeling.ridge_models(modeling.fold_factors(training, places_of(training)), ALPHAS)
    return models.select("fold", "alpha", r("intercept").alias("intercept"), "training_rows", "training_end",
                         F.posexplode("coefficients").alias("k", "coefficient"))


def ridge_normal_equations(spark, sf):
    """Whether the ten-feature models solve the normal equations made of the sums of squares, feature by feature."""
    training = rows(spark, sf)
    places = materialize(places_of(training))
    sums = modeling.fold_moments(training, places)
    models = modeling.ridge_models(modeling.fold_factors(training, places), ALPHAS)
    size = len(features.FEATURES)
    mean = [F.col(f"sx_{a}") / F.col("n") for a in range(size)]
    sd = [F.sqrt(F.col(f"sxx_{a}_{a}") / F.col("n") - mean[a] * mean[a]) for a in range(size)]
    left = lambda a: sum((F.col(f"sxx_{min(a, b)}_{max(a, b)}") - F.col("n") * mean[a] * mean[b]) / (sd[a] * sd[b]) * F.col("coefficients")[b]
                         for b in range(size)) + F.col("alpha") * F.col("coefficients")[a]
    right = lambda a: (F.col(f"sxy_{a}") - mean[a] * F.col("sy")) / sd[a]
    solved = F.array(*[F.abs(left(a) - right(a)) <= 1e-7 * F.col("n") for a in range(size)])
    return sums.drop("training_end").join(models, "fold").select("fold", "alpha", "training_rows", F.posexplode(solved).alias("k", "solved"))


def scores_by_alpha(spark, sf, names=PAIR):
    training = rows(spark, sf)
    return modeling.walk_forward(training, places_of(training), ALPHAS, names)


def walk_forward_evaluation(spark, sf):
    return scores_by_alpha(spark, sf).select(
        "alpha", r("mean_rank_correlation").alias("mean_rank_correlation"), "independent_dates")


def walk_forward_all(spark, sf):
    return scores_by_alpha(spark, sf, features.FEATURES)


def alpha_selection(spark, sf):
    training = rows(spark, sf)
    scores = materialize(modeling.walk_forward(training, places_of(training), ALPHAS, PAIR))
    chosen = modeling.selected_model(training, scores, ALPHAS, PAIR)
    return chosen.select(
        "alpha", r("development_score").alias("development_score"), "training_rows",
        *[r(F.col("coefficients")[k], 7).alias(f"coefficient_{k}") for k in range(2)])


def fixed_model(spark):
    """A model with stated numbers, so that scoring can be checked on its own."""
    return spark.createDataFrame(
        [(0, 1.0, 0.01, [0.1, 4.0], [0.5, 2.0], [0.03, -0.02], 1, None)], modeling.MODEL_SCHEMA)


def linear_scores(spark, sf):
    training = rows(spark, sf)
    one = F.lit(1).alias("one")
    scored = training.withColumn("one", one).join(F.broadcast(fixed_model(spark).withColumn("one", one)), "one")
    return scored.select("symbol", "decision_date", r(modeling.score(PAIR)).alias("predicted_excess"))


def fixed_predictions(training, spark):
    one = F.lit(1).alias("one")
    return training.withColumn("one", one).join(
        F.broadcast(fixed_model(spark).withColumn("one", one)), "one").select(
        "alpha", "decision_date", "symbol", r(modeling.score(PAIR), 9).alias("predicted_excess"),
        r("excess_return", 9).alias("realized_excess"))


def rank_correlation(spark, sf):
    found = modeling.rank_correlations(fixed_predictions(rows(spark, sf), spark))
    return found.select("decision_date", r("correlation").alias("correlation"), "names")


def mean_rank_correlation(spark, sf):
    found = modeling.rank_correlations(fixed_predictions(rows(spark, sf), spark))
    return modeling.mean_rank_correlation(found).select(
        r("mean_rank_correlation").alias("mean_rank_correlation"), "independent_dates")


def clustered_interval(spark, sf):
    observations = rows(spark, sf).select(F.col("decision_date").alias("date"), F.col("excess_return").alias("value"))
    return modeling.clustered_mean_interval(observations, 0.95, 500, 7).select(
        r("estimate").alias("estimate"), r("lower").alias("lower"), r("upper").alias("upper"), "confidence",
        "independent_dates", "resamples", "seed")


# ------------------------------------------------------------------ allocation

def brand():
    return F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")


def context(bars, shots):
    share = bars.groupBy("symbol").agg(F.avg((F.col("quality") == "PASS").cast("double")).alias("evidence_completeness"))
    return shots.join(share, "symbol").select(
        F.col("as_of").alias("decision"), "symbol", d.sector().alias("sector"), "evidence_completeness",
        F.col("average_dollar_volume_21d").alias("average_dollar_volume"), (brand() % 11 != 5).alias("approved"))


def candidates(spark, sf):
    shots, bars, _ = snapshots(spark, sf)
    monthly = materialize(shots.filter("day(as_of) <= 7 AND momentum_21d IS NOT NULL AND realized_volatility_21d IS NOT NULL"))
    rows_ = monthly.select(
        F.col("as_of").alias("decision"), "symbol", r("momentum_21d", 9).alias("expected_excess_return"),
        r(F.col("realized_volatility_21d") / 40, 9).alias("uncertainty"))
    return rows_.join(context(bars, monthly), ["decision", "symbol"]), monthly


def current(rows_):
    return rows_.filter(brand() % 4 == 0).select("decision", "symbol", F.lit(0.05).alias("weight"))


def candidate_checks(spark, sf):
    rows_, _ = candidates(spark, sf)
    return allocation.candidate_checks(rows_, LIMITS).groupBy("decision", "check").agg(
        F.count_if("passed").alias("passed"), F.count("*").alias("candidates"))


def desired_weights(spark, sf):
    rows_, _ = candidates(spark, sf)
    return allocation.desired_weights(rows_, LIMITS).select(
        "decision", "symbol", "sector", r("score").alias("score"), r("weight").alias("weight"))


def weight_columns(rows_):
    return rows_.select("decision", "symbol", *[
        r(c).alias(c) for c in ("current", "desired", "weight", "turnover", "cash_weight")])


def target_weights(spark, sf):
    rows_, _ = candidates(spark, sf)
    return weight_columns(allocation.allocate(rows_, current(rows_), LIMITS))


def sector_totals(spark, sf):
    rows_, _ = candidates(spark, sf)
    return allocation.sector_weights(current(rows_), rows_, LIMITS).select(
        "decision", "sector", r("weight").alias("weight"), "within_limit")


def planted_portfolios(rows_):
    month = F.month("decision")
    held = rows_.filter(brand() % 4 == 0).select(
        "decision", "symbol",
        F.when(month == 2, 0.11).when(month == 5, F.when(brand() == 4, -0.01).otherwise(0.05)).otherwise(0.05).alias("weight"))
    stray = rows_.filter(month == 7).select("decision").distinct().select(
        "decision", F.lit("Brand-99").alias("symbol"), F.lit(0.02).alias("weight"))
    whole = rows_.filter(month == 9).select("decision", "symbol", F.lit(0.09).alias("weight"))
    return held.filter("month(decision) <> 9").unionByName(stray).unionByName(whole)


def portfolio_violations(spark, sf):
    rows_, _ = candidates(spark, sf)
    doubled = rows_.unionByName(rows_.filter("month(decision) = 11 AND symbol = 'Brand-3'"))
    return allocation.portfolio_violations(planted_portfolios(rows_), doubled, LIMITS).select(
        "decision", joined("violations").alias("violations"))


def version_match(spark, sf):
    shots, _, _ = snapshots(spark, sf)
    monthly = shots.filter("day(as_of) <= 7").withColumn("feature_version", F.when(
        brand() == 3, F.lit("price-features-v0")).otherwise(F.col("feature_version")))
    bad = allocation.version_mismatches(monthly, features.FEATURE_VERSION).select(
        "symbol", "as_of", F.lit("feature/model version mismatch").alias("problem"))
    gaps = allocation.unscorable(monthly, PAIR).select("symbol", "as_of", joined("missing").alias("problem"))
    return bad.unionByName(gaps)


def allocate_from_model(spark, sf):
    shots, bars, _ = snapshots(spark, sf)
    monthly = materialize(shots.filter("day(as_of) <= 7").withColumn("decision", F.col("as_of")))
    limits = allocation.Constraints(
        minimum_evidence_completeness=0.985, minimum_average_dollar_volume=8_000, minimum_excess_return=0.0)
    rows_ = allocation.scored_candidates(
        monthly, fixed_model(spark), context(bars, monthly), 0.1, features.FEATURE_VERSION, PAIR)
    rows_ = rows_.withColumn("expected_excess_return", r("expected_excess_return", 9))
    return weight_columns(allocation.allocate(rows_, current(rows_), limits))


def allocate_trained(spark, sf):
    """From training rows to weights: alpha by walk-forward, refit on all rows, scores, allocation."""
    shots, bars, bench = snapshots(spark, sf)
    training = materialize(modeling.training_rows(shots, bars, bench, HORIZON, CUTOFF))
    scores = materialize(modeling.walk_forward(training, places_of(training), ALPHAS, PAIR))
    model = materialize(modeling.selected_model(training, scores, ALPHAS, PAIR))
    monthly = materialize(shots.filter("day(as_of) <= 7").withColumn("decision", F.col("as_of")))
    limits = allocation.Constraints(
        minimum_evidence_completeness=0.985, minimum_average_dollar_volume=8_000, minimum_excess_return=0.0)
    rows_ = allocation.scored_candidates(monthly, model, context(bars, monthly), 0.1, features.FEATURE_VERSION, PAIR)
    return weight_columns(allocation.allocate(rows_, current(rows_), limits))


def promotion_metrics(spark, sf):
    curve = materialize(rebalanced(COST)(spark, sf))
    found = metrics.performance_metrics(curve, ["strategy"]).join(
        metrics.annual_turnover(curve, ["strategy"]), "strategy")
    ranked = F.col("strategy") != "equal_weight"
    return found.select(
        "strategy", F.col("decision_dates").alias("independent_dates"),
        F.when(ranked, F.lit(0.05)).alias("rank_correlation"), "information_ratio", "max_drawdown", "annual_turnover",
        F.when(ranked, F.lit(1)).otherwise(F.lit(0)).alias("holdout_opened"))


def promotion_gates(spark, sf):
    return gates.promotion_checks(promotion_metrics(spark, sf), ["strategy"])


QUERIES = {
    "training_rows": training_rows,
    "demeaned_labels": demeaned_labels,
    "label_gaps": label_gaps,
    "walk_forward_folds": walk_forward_folds,
    "fold_leakage": fold_leakage,
    "selection_confinement": confinement,
    "fold_correlation_moments": correlation_moments,
    "ridge_models": ridge_models,
    "ridge_models_all_features": ridge_models_all,
    "ridge_normal_equations": ridge_normal_equations,
    "walk_forward_evaluation": walk_forward_evaluation,
    "walk_forward_all_features": walk_forward_all,
    "alpha_selection": alpha_selection,
    "linear_scores": linear_scores,
    "rank_correlation": rank_correlation,
    "mean_rank_correlation": mean_rank_correlation,
    "clustered_mean_interval": clustered_interval,
    "candidate_checks": candidate_checks,
    "desired_weights": desired_weights,
    "target_weights": target_weights,
    "sector_totals": sector_totals,
    "portfolio_violations": portfolio_violations,
    "model_version_match": version_match,
    "allocate_from_model": allocate_from_model,
    "allocate_from_trained_model": allocate_trained,
    "promotion_gates": promotion_gates,
}
