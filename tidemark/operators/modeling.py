"""Forward-return labels, purged folds, ridge models from triangular factors, and walk-forward evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.columns import dbl
from tidemark.operators.features import FEATURES
from tidemark.session import materialize

MODEL_SCHEMA = (
    "fold int, alpha double, intercept double, means array<double>, scales array<double>, "
    "coefficients array<double>, training_rows bigint, training_end date"
)


def _forward(rows: DataFrame, keys: Sequence[str], horizon: int, prefix: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("session")
    return rows.select(
        *keys, F.col("session").alias("decision_date"),
        F.lead("session", horizon).over(order).alias(f"{prefix}end"),
        (F.lead(dbl("close"), horizon).over(order) / dbl("close") - 1).alias(f"{prefix}return"))


def training_rows(
    snapshots: DataFrame, bars: DataFrame, benchmark: DataFrame, horizon: int, label_cutoff: str,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Features with the return over the next ``horizon`` sessions, in excess of the benchmark.

    A row needs the same end date on both sides, an end not after the cutoff, and every feature.
    """
    if horizon <= 0:
        raise ValueError(f"a label needs at least one session ahead, not {horizon}")
    stock = _forward(bars, ["symbol"], horizon, "")
    bench = _forward(benchmark.select("session", "close").withColumn("market", F.lit(1)), ["market"], horizon, "bench_")
    cutoff = F.to_date(F.lit(label_cutoff))
    complete = " AND ".join(f"{name} IS NOT NULL" for name in features)
    return (
        snapshots.filter(complete).withColumnRenamed("as_of", "decision_date")
        .join(stock, ["symbol", "decision_date"])
        .join(F.broadcast(bench.drop("market")), "decision_date")
        .filter((F.col("end") == F.col("bench_end")) & (F.col("end") <= cutoff))
        .select(
            "symbol", "decision_date", "feature_version", *features, F.col("return").alias("forward_return"),
            F.col("bench_return").alias("benchmark_forward_return"),
            (F.col("return") - F.col("bench_return")).alias("excess_return"), F.col("end").alias("label_end_date"))
    )


def demeaned(rows: DataFrame) -> DataFrame:
    """Label centred per decision date: the cross-section of a date sums to zero."""
    return rows.withColumn(
        "target", F.col("excess_return") - F.avg("excess_return").over(W.partitionBy("decision_date")))


def label_gaps(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots that give no training row."""
    return snapshots.select("symbol", F.col("as_of").alias("decision_date")).join(
        rows.select("symbol", "decision_date"), ["symbol", "decision_date"], "left_anti")


# ------------------------------------------------------------------ folds

def numbered_dates(dates: DataFrame) -> DataFrame:
    """Distinct dates with index and count; one row per day, so one window partition is enough."""
    return dates.select("date").distinct().select(
        "date", (F.row_number().over(W.orderBy("date")) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))


def fold_places(
    dates: DataFrame, minimum_train: int, validation: int, purge: int, embargo: int,
) -> DataFrame:
    """Per date: fold it validates in (or null) and first fold it trains in (or null), from 1.

    Training sets expand, so the first fold says everything about a date's membership.
    """
    if min(minimum_train, validation) <= 0 or min(purge, embargo) < 0:
        raise ValueError("folds need a training and a validation window of at least one date and gaps of zero or more")
    step = validation + embargo
    start = minimum_train + purge
    indexed = numbered_dates(dates)
    folds = F.greatest(F.lit(0), F.floor((F.col("n") - start - validation) / step) + 1)
    since = F.col("i") - start
    return indexed.withColumn("folds", folds.cast("int")).select(
        "date", "folds",
        F.when((since >= 0) & (F.pmod(since, F.lit(step)) < validation) & (F.floor(since / step) < F.col("folds")),
               F.floor(since / step) + 1).cast("int").alias("validates_in"),
        F.when(F.greatest(F.lit(0), F.floor((F.col("i") - minimum_train) / step) + 1) < F.col("folds"),
               F.greatest(F.lit(0), F.floor((F.col("i") - minimum_train) / step) + 1) + 1).cast("int")
        .alias("trains_from"))


def purged_walk_forward(
    dates: DataFrame, minimum_train: int, validation: int, purge: int, embargo: int,
) -> DataFrame:
    """Folds in long form (fold, role, date); no rows where there are too few dates for one fold."""
    places = fold_places(dates, minimum_train, validation, purge, embargo)
    train = places.filter("trains_from IS NOT NULL").select(
        F.explode(F.sequence("trains_from", "folds")).alias("fold"), F.lit("train").alias("role"), "date")
    validate = places.filter("validates_in IS NOT NULL").select(
        F.col("validates_in").alias("fold"), F.lit("validate").alias("role"), "date")
    return train.unionByName(validate)


def fold_leakage(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold: last training label end, first validation date, and whether they are apart."""
    ends = rows.groupBy(F.col("decision_date").alias("date")).agg(F.max("label_end_date").alias("label_end"))
    joined = folds.join(F.broadcast(ends), "date")
    return joined.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("label_end"))).alias("train_label_end"),
        F.min(F.when(F.col("role") == "validate", F.col("date"))).alias("first_validation"),
    ).withColumn("clean", F.col("train_label_end") < F.col("first_validation"))


# ------------------------------------------------------------------ ridge

def moment_columns(features: Sequence[str]) -> dict[str, Column]:
    """Sums that determine every ridge fit: counts, x, x*x', x*y, y, for features less a common shift.

    Without the shift, squares of large values with little spread would cancel."""
    sums = {"n": F.count("*"), "sy": F.sum("target"), "training_end": F.max("label_end_date")}
    for a, left in enumerate(features):
        sums[f"sx_{a}"] = F.sum(left)
        sums[f"sxy_{a}"] = F.sum(F.col(left) * F.col("target"))
        for b in range(a, len(features)):
            sums[f"sxx_{a}_{b}"] = F.sum(F.col(left) * F.col(features[b]))
    return sums


def _shifted(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with target and features less their means, and these. Rows of several feature versions are refused: their
    columns do not mean the same."""
    centred = demeaned(rows)
    version = [F.min("feature_version").alias("low"), F.max("feature_version").alias("high")] if "feature_version" in rows.columns else []
    found = centred.agg(*[F.avg(name).alias(f"shift_{a}") for a, name in enumerate(features)], *version).first()
    if version and found["low"] != found["high"]:
        raise ValueError(f"training rows of more than one feature version: {found['low']}, {found['high']}")
    shift = {f"shift_{a}": F.lit(float(found[f"shift_{a}"] or 0.0)) for a in range(len(features))}
    return centred.withColumns({name: F.col(name) - shift[f"shift_{a}"] for a, name in enumerate(features)}), shift


def _training_starts(places: DataFrame) -> DataFrame:
    return F.broadcast(places.filter("trains_from IS NOT NULL").select(F.col("date").alias("decision_date"), "trains_from"))


def fold_moments(rows: DataFrame, places: DataFrame | None, features: Sequence[str] = FEATURES) -> DataFrame:
    """One moment row per fold, from one pass over the training rows.

    Rows are summed by the first fold they train in and the sums are cumulated over folds: expanding
    training sets never multiply the rows. Without ``places`` there is one fold 0 of all rows.
    """
    centred, shift = _shifted(rows, features)
    columns = moment_columns(features)
    names = list(columns)
    if places is None:
        return centred.groupBy(F.lit(0).alias("fold")).agg(*[columns[n].alias(n) for n in names]).withColumns(shift)
    parts = centred.join(_training_starts(places), "decision_date").groupBy(F.col("trains_from").alias("fold")).agg(
        *[columns[n].alias(n) for n in names])
    whole = places.agg(F.max("folds").alias("folds")).filter("folds > 0").select(
        F.explode(F.sequence(F.lit(1), "folds")).alias("fold"))
    so_far = W.orderBy("fold").rowsBetween(W.unboundedPreceding, 0)
    return whole.join(parts, "fold", "left").select("fold", *[
        (F.max(n) if n == "training_end" else F.sum(n)).over(so_far).alias(n) for n in names]).filter("n > 0").withColumns(shift)


FACTORS = "fold int, factor binary, n bigint, training_end date"


def _triangle(*blocks: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of stacked rows, which is all a least squares fit needs of them; R of fewer rows than columns
    is filled up, so that all have one shape."""
    found = np.linalg.qr(np.concatenate(blocks), mode="r")
    return np.concatenate([found, np.zeros((found.shape[1] - len(found), found.shape[1]))])


def _merged(frame: pd.DataFrame, size: int) -> pd.DataFrame:
    """One row of the factors of one fold."""
    blocks = [np.frombuffer(f).reshape(size, size) for f in frame["factor"]]
    ends = [end for end in frame["training_end"] if end is not None]
    return pd.DataFrame({"fold": [frame["fold"].iloc[0]], "factor": [_triangle(*blocks).tobytes()], "n": [int(frame["n"].sum())],
                         "training_end": [max(ends, default=None)]})


def fold_factors(rows: DataFrame, places: DataFrame | None, features: Sequence[str] = FEATURES) -> DataFrame:
    """One triangular factor of (1, features, target) per fold, from one pass over the training rows.

    Every task reduces its rows of a fold to a triangle of p + 2 columns, triangles are stacked and reduced per fold and then
    over folds, as training sets expand. Nothing is squared, so features that are almost a combination of others keep half
    their digits more than sums of squares would. Without ``places`` there is one fold 0 of all rows."""
    centred, shift = _shifted(rows, features)
    size = len(features) + 2
    columns = [*features, "target"]
    if places is None:
        parts = centred.withColumn("fold", F.lit(0))
    else:
        parts = centred.join(_training_starts(places), "decision_date").withColumn("fold", F.col("trains_from"))

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, int, object]] = {}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                values = np.column_stack([np.ones(len(part)), part[columns].to_numpy(np.float64)])
                before, n, end = held.get(fold, (np.zeros((0, size)), 0, None))
                ends = [e for e in (end, part["label_end_date"].max()) if e is not None]
                held[fold] = _triangle(before, values), n + len(part), max(ends, default=None)
        yield pd.DataFrame([(fold, r.tobytes(), n, end) for fold, (r, n, end) in held.items()], columns=["fold", "factor", "n", "training_end"])

    parts = parts.select(F.col("fold").cast("int").alias("fold"), *columns, "label_end_date").mapInPandas(reduced, FACTORS)
    merged = parts.groupBy("fold").applyInPandas(lambda frame: _merged(frame, size), FACTORS)
    if places is None:
        return merged.withColumns(shift)

    def cumulated(frame: pd.DataFrame) -> pd.DataFrame:
        known = {fold: group for fold, group in frame[frame["n"].notna()].groupby("fold")}
        so_far, out = None, []
        for fold in sorted(frame["fold"]):
            parts_ = [x for x in (so_far, known.get(fold)) if x is not None]
            if parts_:
                so_far = _merged(pd.concat(parts_), size).assign(fold=fold)
                out.append(so_far)
        return pd.concat(out) if out else frame.iloc[:0][["fold", "factor", "n", "training_end"]]

    whole = places.agg(F.max("folds").alias("folds")).filter("folds > 0").select(F.explode(F.sequence(F.lit(1), F.col("folds").cast("int"))).alias("fold"))
    # One short row per fold.
    return whole.join(merged, "fold", "left").groupBy(F.lit(0).alias("_all")).applyInPandas(
        lambda frame: cumulated(frame), FACTORS).withColumns(shift)


MODEL_COLUMNS = ["fold", "alpha", "intercept", "means", "scales", "coefficients", "training_rows", "training_end"]


def solve_factors(factors: pd.DataFrame, alphas: Sequence[float], size: int) -> pd.DataFrame:
    """Standardised ridge with unpenalised intercept for every (factor row, alpha), as least squares of the triangle."""
    out = []
    for row in factors.itertuples(index=False):
        n, whole = float(row.n), np.frombuffer(row.factor).reshape(size + 2, size + 2)
        # The first column is constant: its row of the triangle has the means, and the rest is about them.
        means, intercept = whole[0, 1:size + 1] / whole[0, 0], float(whole[0, size + 1] / whole[0, 0])
        spread, right = whole[1:, 1:size + 1], whole[1:, size + 1]
        variance = (spread * spread).sum(axis=0) / n
        flat = variance <= 1e-14 * np.maximum(1.0, variance + means * means)
        scales = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, variance)))
        standard = np.where(flat, 0.0, spread / scales)
        shift = np.array([getattr(row, f"shift_{a}") for a in range(size)])
        for alpha in alphas:
            rows = np.concatenate([standard, math.sqrt(alpha) * np.eye(size)])
            weights = np.linalg.lstsq(rows, np.concatenate([right, np.zeros(size)]), rcond=None)[0]
            out.append((row.fold, float(alpha), intercept, (means + shift).tolist(), scales.tolist(), weights.tolist(), int(n), row.training_end))
    return pd.DataFrame(out, columns=MODEL_COLUMNS)


def solve_moments(moments: pd.DataFrame, alphas: Sequence[float], size: int) -> pd.DataFrame:
    """Standardised ridge with unpenalised intercept for every (moment row, alpha)."""
    out = []
    for row in moments.itertuples(index=False):
        n = float(row.n)
        sx = np.array([getattr(row, f"sx_{a}") for a in range(size)])
        sxy = np.array([getattr(row, f"sxy_{a}") for a in range(size)])
        sxx = np.array([[getattr(row, f"sxx_{min(a, b)}_{max(a, b)}") for b in range(size)] for a in range(size)])
        means = sx / n
        cov = sxx / n - np.outer(means, means)
        variance = np.diag(cov).copy()
        flat = variance <= 1e-14 * np.maximum(1.0, np.diag(sxx) / n)
        shift = np.array([getattr(row, f"shift_{a}") for a in range(size)])
        scales = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, variance)))
        gram = n * cov / np.outer(scales, scales)
        right = (sxy - means * row.sy) / scales
        for alpha in alphas:
            weights = np.linalg.lstsq(gram + alpha * np.eye(size), right, rcond=None)[0]
            out.append((row.fold, float(alpha), row.sy / n, (means + shift).tolist(), scales.tolist(), weights.tolist(),
                        int(n), row.training_end))
    return pd.DataFrame(out, columns=MODEL_COLUMNS)


def ridge_models(sums: DataFrame, alphas: Sequence[float], features: Sequence[str] = FEATURES) -> DataFrame:
    """One model row per (fold, alpha), from fold factors or fold moments: folds x p^2 numbers."""
    if not alphas or min(alphas) < 0:
        raise ValueError(f"ridge penalties below zero or none given: {tuple(alphas)}")
    listed, size = tuple(sorted(set(alphas))), len(features)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield (solve_factors if "factor" in batch else solve_moments)(batch, listed, size)

    return sums.mapInPandas(solve, MODEL_SCHEMA)


def score(features: Sequence[str] = FEATURES) -> Column:
    """Linear prediction from feature columns and the model's arrays; null if a feature is missing."""
    terms = [
        (F.col(name) - F.col("means")[k]) / F.col("scales")[k] * F.col("coefficients")[k]
        for k, name in enumerate(features)]
    total = F.col("intercept")
    for term in terms:
        total = total + term
    return total


def walk_forward_predictions(
    rows: DataFrame, places: DataFrame, models: DataFrame, features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Validation rows scored by the model of their fold, for every alpha (folds x alphas is small)."""
    validate = F.broadcast(places.filter("validates_in IS NOT NULL").select(
        F.col("date").alias("decision_date"), F.col("validates_in").alias("fold")))
    return rows.join(validate, "decision_date").join(F.broadcast(models), "fold").select(
        "fold", "alpha", "decision_date", "symbol", score(features).alias("predicted_excess"),
        F.col("excess_return").alias("realized_excess"))


def rank_correlations(predictions: DataFrame, keys: Sequence[str] = ("alpha",)) -> DataFrame:
    """Ordinal rank correlation per date; ties ranked by symbol; null below two names."""
    date = [*keys, "decision_date"]
    place = lambda column: F.row_number().over(W.partitionBy(*date).orderBy(column, "symbol"))
    ranked = predictions.select(
        *date, "symbol", place("predicted_excess").alias("p"), place("realized_excess").alias("q"))
    n = F.count("*")
    gap = (F.col("p") - F.col("q")).cast("double")
    return ranked.groupBy(*date).agg(
        F.when(n >= 2, 1 - 6 * F.sum(gap * gap) / (n * (n * n - 1))).alias("correlation"), n.alias("names"))


def mean_rank_correlation(correlations: DataFrame, keys: Sequence[str] = ("alpha",)) -> DataFrame:
    return correlations.groupBy(*keys).agg(
        F.coalesce(F.avg("correlation"), F.lit(0.0)).alias("mean_rank_correlation"),
        F.count("*").alias("independent_dates"))


def walk_forward(rows: DataFrame, places: DataFrame, alphas: Sequence[float], features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean rank correlation per alpha. Labels that reach into their fold's validation dates are refused."""
    factors = materialize(fold_factors(rows, places, features))
    starts = places.filter("validates_in IS NOT NULL").groupBy(F.col("validates_in").alias("fold")).agg(F.min("date").alias("first"))
    overlap = factors.join(starts, "fold").filter("training_end >= first").select("fold").limit(1).collect()
    if overlap:
        raise ValueError(f"fold {overlap[0]['fold']} trains on labels that end within its validation: purge more dates")
    models = ridge_models(factors, alphas, features)
    return mean_rank_correlation(rank_correlations(walk_forward_predictions(rows, places, models, features)))


def select_alpha(scores: DataFrame) -> DataFrame:
    """Alpha with the best mean correlation; the smaller one on a tie."""
    best = F.struct(F.round("mean_rank_correlation", 12).alias("score"), (-F.col("alpha")).alias("minus_alpha"))
    return scores.groupBy().agg(F.max(best).alias("best")).select(
        (-F.col("best.minus_alpha")).alias("alpha"), F.col("best.score").alias("development_score"))


def selected_model(
    rows: DataFrame, scores: DataFrame, alphas: Sequence[float], features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Model of the selected alpha refitted on all rows; every alpha is solved from the same factor."""
    models = ridge_models(fold_factors(rows, None, features), alphas, features)
    return models.join(F.broadcast(select_alpha(scores)), "alpha")


# ------------------------------------------------------------------ clustered bootstrap

def date_means(observations: DataFrame) -> DataFrame:
    return observations.groupBy("date").agg(F.avg("value").alias("mean"))


def percentile_places(confidence: float, resamples: int) -> tuple[int, int]:
    tail = (1 - confidence) / 2
    return max(0, math.floor(tail * resamples)), min(resamples - 1, math.ceil((1 - tail) * resamples) - 1)


def draw(seed: int, resample: Column, i: Column, n: Column) -> Column:
    """Reproducible draw of a date number: the first 32 bits of md5('seed:resample:i') modulo n."""
    text = F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), i.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def clustered_mean_interval(
    observations: DataFrame, confidence: float = 0.95, resamples: int = 2_000, seed: int = 7,
) -> DataFrame:
    """Mean of date means with a percentile bootstrap over dates.

    Observations are reduced to one mean per date first. Resamples are spread over tasks; each draws
    dates from the broadcast table of means, which holds one row per day.
    """
    if not 0 < confidence < 1 or resamples < 100:
        raise ValueError("the bootstrap needs one draw or more and a confidence strictly between 0 and 1")
    means = date_means(observations).select(
        "date", "mean", (F.row_number().over(W.orderBy("date")) - 1).cast("bigint").alias("k"))
    n = means.agg(F.count("*")).scalar()
    spark = observations.sparkSession
    draws = spark.range(resamples).withColumn("n", n).select(
        F.col("id").alias("resample"), "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(
        "resample", draw(seed, F.col("resample"), F.col("i"), F.col("n")).alias("k"))
    samples = draws.join(F.broadcast(means), "k").groupBy("resample").agg(F.avg("mean").alias("sample"))
    placed = samples.withColumn("place", F.row_number().over(W.orderBy("sample")) - 1)
    low, high = percentile_places(confidence, resamples)
    estimate = means.agg(F.avg("mean").alias("estimate"), F.count("*").alias("independent_dates"))
    bounds = placed.groupBy().agg(
        F.max(F.when(F.col("place") == low, F.col("sample"))).alias("lower"),
        F.max(F.when(F.col("place") == high, F.col("sample"))).alias("upper"))
    one = F.lit(1).alias("one")
    return estimate.withColumn("one", one).join(bounds.withColumn("one", one), "one").select(
        "estimate", "lower", "upper", F.lit(confidence).alias("confidence"), "independent_dates",
        F.lit(resamples).alias("resamples"), F.lit(seed).alias("seed"))
