"""Labels, folds, ridge, bootstrap and constrained weights."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from helpers import bars, day, series
from pyspark.sql import functions as F

from tidemark.operators import allocation, gates, modeling


def test_label_needs_both_ends_inside_the_cutoff(spark):
    table = bars(spark, series("A", [100, 101, 103, 106]))
    bench = bars(spark, series("M", [100, 100, 101, 101]))
    shots = spark.createDataFrame([("A", day(i), "v", 1.0 if i != 1 else None) for i in range(4)],
                                  "symbol string, as_of date, feature_version string, x double")
    rows = modeling.training_rows(shots, table, bench, 1, str(day(2)), ["x"]).collect()
    assert [(r["decision_date"], r["label_end_date"]) for r in rows] == [(day(0), day(1))]
    assert rows[0]["excess_return"] == pytest.approx(0.01)
    assert modeling.label_gaps(modeling.training_rows(shots, table, bench, 1, str(day(2)), ["x"]), shots).count() == 3


def plain_folds(n, minimum, size, purge, embargo):
    out, start = [], minimum + purge
    while start + size <= n:
        out.append((list(range(start - purge)), list(range(start, start + size))))
        start += size + embargo
    return out


@pytest.mark.parametrize("sizes", [(30, 10, 5, 2, 1), (50, 7, 3, 0, 0), (41, 20, 5, 4, 6), (9, 10, 5, 2, 1)])
def test_folds_match_the_definition(spark, sizes):
    n, *rest = sizes
    dates = spark.createDataFrame([(day(i),) for i in range(n)], "date date")
    found = {}
    for r in modeling.purged_walk_forward(dates, *rest).collect():
        found.setdefault((r["fold"], r["role"]), []).append((r["date"] - day(0)).days)
    expected = plain_folds(n, *rest)
    assert len(found) == 2 * len(expected)
    for k, (train, validate) in enumerate(expected, start=1):
        assert sorted(found[(k, "train")]) == train and sorted(found[(k, "validate")]) == validate


def panel(spark, seed=4, days=40):
    rng, rows = random.Random(seed), []
    for i in range(days):
        for s in "ABCDE":
            x, y = rng.gauss(5, 2), rng.gauss(-1, 0.5)
            rows.append((s, day(i), x, y, 3.0, 0.02 * x - 0.05 * y + rng.gauss(0, 0.05), day(i + 1)))
    return rows, spark.createDataFrame(
        rows, "symbol string, decision_date date, x double, y double, c double, excess_return double, label_end_date date")


def plain_ridge(rows, alpha):
    matrix = np.array([[r[2], r[3], r[4]] for r in rows])
    means = {d: np.mean([r[5] for r in rows if r[1] == d]) for d in {r[1] for r in rows}}
    target = np.array([r[5] - means[r[1]] for r in rows])
    scale = matrix.std(axis=0)
    scale[scale == 0] = 1.0
    z = (matrix - matrix.mean(axis=0)) / scale
    return np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ target)


def test_fold_models_equal_direct_ridge(spark):
    rows, df = panel(spark)
    dates = df.select(F.col("decision_date").alias("date")).distinct()
    places = modeling.fold_places(dates, 15, 5, 2, 1)
    names = ("x", "y", "c")
    models = modeling.ridge_models(modeling.fold_moments(df, places, names), (0.5, 10.0), names).collect()
    folds = plain_folds(40, 15, 5, 2, 1)
    assert len(models) == 2 * len(folds)
    for m in models:
        train = [r for r in rows if (r[1] - day(0)).days in folds[m["fold"] - 1][0]]
        assert m["training_rows"] == len(train)
        assert m["coefficients"] == pytest.approx(plain_ridge(train, m["alpha"]).tolist(), abs=1e-9)
        assert m["intercept"] == pytest.approx(0, abs=1e-12)


def test_walk_forward_ranks_and_alpha_choice(spark):
    rows = [(s, day(i), float(v), v / 100, day(i + 1)) for i in range(8) for s, v in (("A", -1), ("B", 0), ("C", 1))]
    df = spark.createDataFrame(rows, "symbol string, decision_date date, x double, excess_return double, label_end_date date")
    places = modeling.fold_places(df.select(F.col("decision_date").alias("date")), 3, 2, 1, 0)
    scores = modeling.walk_forward(df, places, (1.0, 0.1), ("x",))
    assert {(r["mean_rank_correlation"], r["independent_dates"]) for r in scores.collect()} == {(1.0, 4)}
    assert modeling.select_alpha(scores).first()["alpha"] == 0.1
    chosen = modeling.selected_model(df, scores, (1.0, 0.1), ("x",)).collect()
    assert len(chosen) == 1 and chosen[0]["training_rows"] == 24


def test_leaking_folds_are_found(spark):
    _, df = panel(spark)
    dates = df.select(F.col("decision_date").alias("date")).distinct()
    for purge, clean in ((2, True), (0, False)):
        found = modeling.fold_leakage(df, modeling.purged_walk_forward(dates, 15, 5, purge, 0)).collect()
        assert found and {r["clean"] for r in found} == {clean}


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    rows = [(date(2020, 1, 1) + timedelta(days=i), v) for i in range(10) for v in (float(i), i + 0.5)]
    df = spark.createDataFrame(rows, "date date, value double")
    one, two = (modeling.clustered_mean_interval(df, 0.9, 200, 7).first() for _ in range(2))
    assert one == two and one["lower"] < one["estimate"] < one["upper"]
    assert one["estimate"] == pytest.approx(4.75) and one["independent_dates"] == 10


def greedy(candidates, current, c):
    """Plain loop: best score first, each name takes what position, sector and cash caps leave."""
    keep = [x for x in candidates if x["approved"] and x["ex"] >= c.minimum_excess_return and 0 <= x["unc"] <= c.maximum_uncertainty]
    keep.sort(key=lambda x: (-x["ex"] / max(x["unc"], 1e-6), x["symbol"]))
    wanted, sectors, left = {}, {}, c.maximum_invested_weight
    for x in keep:
        w = max(0.0, min(c.maximum_position_weight, c.maximum_sector_weight - sectors.get(x["sector"], 0.0), left))
        if w > 0:
            wanted[x["symbol"]] = w
            sectors[x["sector"]] = sectors.get(x["sector"], 0.0) + w
            left -= w
    names = set(wanted) | set(current)
    total = sum(abs(wanted.get(s, 0) - current.get(s, 0)) for s in names)
    scale = min(1.0, c.maximum_turnover / total) if total else 1.0
    return {s: current.get(s, 0) + scale * (wanted.get(s, 0) - current.get(s, 0)) for s in names}


def test_weights_equal_the_greedy_loop(spark):
    rng = random.Random(9)
    rows, held, expected = [], [], {}
    limits = allocation.Constraints(maximum_position_weight=0.1, maximum_sector_weight=0.25, maximum_invested_weight=0.83, maximum_turnover=0.6)
    for k in range(25):
        d = day(k)
        names = [{"symbol": f"S{n}", "sector": rng.choice("XYZW"), "ex": rng.uniform(-0.02, 0.2), "unc": rng.uniform(0, 0.17),
                  "approved": rng.random() < 0.9} for n in range(rng.randrange(1, 20))]
        now = {x["symbol"]: 0.05 for x in names if rng.random() < 0.3}
        rows += [(d, x["symbol"], x["sector"], x["ex"], x["unc"], 1.0, 1e9, x["approved"]) for x in names]
        held += [(d, s, w) for s, w in now.items()]
        expected.update({(d, s): w for s, w in greedy(names, now, limits).items()})
    df = spark.createDataFrame(rows, "decision date, symbol string, sector string, expected_excess_return double, uncertainty double, "
                               "evidence_completeness double, average_dollar_volume double, approved boolean")
    current = spark.createDataFrame(held, "decision date, symbol string, weight double")
    found = {(r["decision"], r["symbol"]): r["weight"] for r in allocation.allocate(df, current, limits).collect()}
    assert set(found) == set(expected)
    for key, weight in expected.items():
        assert found[key] == pytest.approx(weight, abs=1e-12)


def test_limits_are_checked(spark):
    with pytest.raises(ValueError, match="sector"):
        allocation.Constraints(maximum_position_weight=0.5, maximum_sector_weight=0.2)
    df = spark.createDataFrame([("m", 100.0, None, 0.3, -0.15, 4.0, 1)],
                               "name string, independent_dates double, rank_correlation double, information_ratio double, "
                               "max_drawdown double, annual_turnover double, holdout_opened int")
    checks = {r["check"]: r["passed"] for r in gates.promotion_checks(df, ["name"]).collect()}
    assert checks.pop("rank_correlation") is False and all(checks.values())


def test_large_features_with_little_spread_keep_their_weights(spark):
    rows, _ = panel(spark)
    schema = "symbol string, decision_date date, x double, y double, c double, excess_return double, label_end_date date"
    moved = spark.createDataFrame([(*r[:2], r[2] + 1e9, *r[3:]) for r in rows], schema)
    plain = spark.createDataFrame(rows, schema)
    names = ("x", "y", "c")
    one, two = (modeling.ridge_models(modeling.fold_moments(df, None, names), (1.0,), names).first() for df in (plain, moved))
    assert two["coefficients"] == pytest.approx(one["coefficients"], rel=1e-5) and two["scales"] == pytest.approx(one["scales"], rel=1e-6)
    assert two["means"][0] == pytest.approx(one["means"][0] + 1e9)


def test_overlapping_labels_are_refused(spark):
    _, df = panel(spark)
    places = modeling.fold_places(df.select(F.col("decision_date").alias("date")).distinct(), 15, 5, 0, 0)
    with pytest.raises(ValueError, match="purge"):
        modeling.walk_forward(df, places, (1.0,), ("x", "y"))


def test_each_decision_has_its_model(spark):
    shots = spark.createDataFrame([(1, "A", "v", 2.0), (2, "A", "v", 2.0)], "decision int, symbol string, feature_version string, x double")
    context = spark.createDataFrame([(1, "A"), (2, "A")], "decision int, symbol string")
    model = spark.createDataFrame([(0, 1.0, 0.0, [0.0], [1.0], [w], 1, None) for w in (1.0, 3.0)], modeling.MODEL_SCHEMA)
    with pytest.raises(ValueError, match="several"):
        allocation.scored_candidates(shots, model, context, 0.1, "v", ("x",))
    keyed = model.withColumn("decision", F.when(F.col("coefficients")[0] == 1, 1).otherwise(2))
    found = allocation.scored_candidates(shots, keyed, context, 0.1, "v", ("x",)).collect()
    assert {r["decision"]: r["expected_excess_return"] for r in found} == {1: 2.0, 2: 6.0}


def test_factors_equal_moments_and_direct_ridge(spark):
    rows, df = panel(spark)
    places = modeling.fold_places(df.select(F.col("decision_date").alias("date")).distinct(), 15, 5, 2, 1)
    names = ("x", "y", "c")
    one = modeling.ridge_models(modeling.fold_moments(df, places, names), (0.5, 10.0), names).orderBy("fold", "alpha").collect()
    two = modeling.ridge_models(modeling.fold_factors(df.repartition(7), places, names), (0.5, 10.0), names).orderBy("fold", "alpha").collect()
    assert len(one) == len(two) > 0
    for a, b in zip(one, two, strict=True):
        assert (a["fold"], a["alpha"], a["training_rows"], a["training_end"]) == (b["fold"], b["alpha"], b["training_rows"], b["training_end"])
        for name in ("coefficients", "means", "scales"):
            assert b[name] == pytest.approx(a[name], abs=1e-9)


def test_nearly_collinear_features_are_fitted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    z = x + 1e-9 * rng.normal(size=400)
    values = np.column_stack([x, z])
    y = 2 * x + 3e9 * (z - x)
    schema = "symbol string, decision_date date, x double, z double, excess_return double, label_end_date date"
    df = spark.createDataFrame([(f"S{k}", day(0), float(x[k]), float(z[k]), float(y[k]), day(1)) for k in range(400)], schema)
    found = modeling.ridge_models(modeling.fold_factors(df.repartition(5), None, ("x", "z")), (0.0,), ("x", "z")).first()
    predicted = np.array(found["intercept"]) + (values - found["means"]) / found["scales"] @ np.array(found["coefficients"])
    target = y - y.mean()
    assert np.abs(predicted - target).max() <= 1e-6 * np.abs(target).max()


def test_mixed_feature_versions_are_refused(spark):
    _, df = panel(spark)
    mixed = df.withColumn("feature_version", F.when(F.col("symbol") == df.first()["symbol"], "v1").otherwise("v2"))
    for fit in (modeling.fold_factors, modeling.fold_moments):
        with pytest.raises(ValueError, match="feature version"):
            fit(mixed, None, ("x", "y"))
    assert modeling.fold_factors(mixed.withColumn("feature_version", F.lit("v1")), None, ("x", "y")).count() == 1
