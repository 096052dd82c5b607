"""Closed-form curves against plain step-by-step simulations, and the no-look-ahead rules."""

from __future__ import annotations

import random

import pytest
from helpers import bar, bars, day, series
from pyspark.sql import functions as F

from tidemark.operators import curves, metrics, strategies
from tidemark.plans import compare
from tidemark.plans.universe import CoverageError, point_in_time_curve


def simulate_long_flat(rows, signal, bps):
    """Day loop of one instrument: trade at the open on yesterday's signal."""
    cash, shares, want, out = 1.0, 0.0, 0.0, []
    for i, b in enumerate(rows):
        if i:
            shares *= b["split"]
            cash += shares * b["div"]
            target = (cash + shares * b["open"]) * want / b["open"]
            cost = abs(target - shares) * b["open"] * bps / 1e4
            if target > shares:
                target = min(target, shares + max(0.0, (cash - cost) / b["open"]))
            cash -= (target - shares) * b["open"] + cost
            shares = target
        out.append(cash + shares * b["close"])
        want = signal(rows[: i + 1])
    return out


def momentum(lookback):
    def signal(seen):
        if len(seen) <= lookback:
            return 0.0
        growth = 1.0
        for old, new in zip(seen[-1 - lookback:], seen[-lookback:]):
            growth *= new["split"] * (new["close"] + new["div"]) / old["close"]
        return 1.0 if round(growth, 12) > 1 else 0.0
    return signal


def random_bars(rng, n):
    price, rows = 100.0, []
    for _ in range(n):
        split = 2.0 if rng.random() < 0.05 else 1.0
        open_ = price * rng.uniform(0.95, 1.05) / split
        price = open_ * rng.uniform(0.95, 1.06)
        rows.append({"open": open_, "close": price, "split": split, "div": rng.choice([0.0, 0.0, 0.0, 0.7])})
    return rows


@pytest.mark.parametrize("bps", [0.0, 5.0, 50.0])
def test_long_flat_curve_equals_the_day_loop(spark, bps):
    rng = random.Random(int(bps) + 1)
    data = {s: random_bars(rng, 60) for s in ("A", "B")}
    rows = [bar(s, i, b["close"], b["open"], dividend=b["div"], split=b["split"]) for s, bs in data.items() for i, b in enumerate(bs)]
    bench = bars(spark, series("M", [100 + i for i in range(60)]))
    found = curves.long_flat_curves(bars(spark, rows), bench, (3, 10), bps).collect()
    for symbol, history in data.items():
        for name, signal in (("buy_and_hold", lambda _: 1.0), ("momentum_3", momentum(3)), ("momentum_10", momentum(10))):
            mine = sorted((r["i"], r["equity"]) for r in found if (r["symbol"], r["candidate"]) == (symbol, name))
            assert [e for _, e in mine] == pytest.approx(simulate_long_flat(history, signal, bps), rel=1e-10)


def test_signal_day_move_is_not_earned(spark):
    points = curves.long_flat_curves(
        bars(spark, series("A", [100, 200, 200])), bars(spark, series("M", [100, 100, 100])), (1,), 0.0)
    flat = {r["session"]: r["equity"] for r in points.filter("candidate = 'momentum_1'").collect()}
    assert flat[day(1)] == 1.0 and flat[day(2)] == 1.0


def test_split_and_dividend_keep_wealth(spark):
    halved = bars(spark, [bar("A", 0, 100), bar("A", 1, 50, split=2), bar("A", 2, 55)])
    value = [r["value"] for r in curves.buy_and_hold_value(halved).orderBy("session").collect()]
    assert value == pytest.approx([1.0, 1.0, 1.1])
    paid = bars(spark, [bar("A", 0, 100), bar("A", 1, 100), bar("A", 2, 99, dividend=1)])
    assert curves.buy_and_hold_value(paid).agg(F.min("value")).first()[0] == pytest.approx(1.0)


def simulate_rebalanced(data, weights_at, every, bps=0.0):
    """Session loop over several symbols with full sells and buys at each execution (no cost scaling)."""
    symbols = sorted(data)
    cash, shares, pending, out = 1.0, dict.fromkeys(symbols, 0.0), None, []
    for i in range(len(data[symbols[0]])):
        if i:
            for s in symbols:
                shares[s] *= data[s][i]["split"]
                cash += shares[s] * data[s][i]["div"]
        turnover = 0.0
        if pending is not None:
            equity = cash + sum(shares[s] * data[s][i]["open"] for s in symbols)
            goal = {s: equity * pending.get(s, 0.0) / data[s][i]["open"] for s in symbols}
            turnover = sum(abs(goal[s] - shares[s]) * data[s][i]["open"] for s in symbols) / equity
            cash = equity - sum(goal[s] * data[s][i]["open"] for s in symbols)
            shares = goal
        out.append((cash + sum(shares[s] * data[s][i]["close"] for s in symbols), turnover))
        pending = weights_at(i) if i % every == 0 else None
    return out


def test_rebalanced_curve_equals_the_session_loop(spark):
    rng = random.Random(11)
    data = {s: random_bars(rng, 37) for s in "ABC"}
    rows = [bar(s, i, b["close"], b["open"], dividend=b["div"], split=b["split"]) for s, bs in data.items() for i, b in enumerate(bs)]
    plan = {i: {s: w for s, w in zip("ABC", (rng.random() / 3 for _ in "ABC"))} for i in range(0, 37, 5)}
    plan[10] = {}
    plan[15] = {"B": 0.9}
    panel, bench = bars(spark, rows), bars(spark, series("M", [100 + i for i in range(37)]))
    schedule = curves.rebalance_calendar(panel.select("session"), 5)
    targets = spark.createDataFrame(
        [("s", day(i), s, w) for i, ws in plan.items() for s, w in ws.items()],
        "strategy string, decision date, symbol string, weight double")
    found = curves.rebalanced_curve(panel, bench, schedule, targets, ["s"]).orderBy("i").collect()
    expected = simulate_rebalanced(data, lambda i: plan[i], 5)
    assert [r["equity"] for r in found] == pytest.approx([e for e, _ in expected], rel=1e-10)
    assert [r["turnover"] for r in found] == pytest.approx([t for _, t in expected], abs=1e-10)
    net = curves.rebalanced_curve(panel, bench, schedule, targets, ["s"], 50.0).orderBy("i").collect()
    factor = 1.0
    for gross, cost in zip(found, net):
        factor *= 1 - 0.005 * gross["turnover"]
        assert cost["equity"] == pytest.approx(gross["equity"] * factor, rel=1e-10)
    weights = curves.position_weights(panel, schedule, targets).groupBy("session").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] <= 1 + 1e-9 for r in weights)


def test_members_change_the_portfolio_and_gaps_stop_it(spark):
    panel = bars(spark, series("A", [100] * 6) + series("B", [50] * 6))
    bench = bars(spark, series("M", [10] * 6))
    members = spark.createDataFrame([(day(0), "A"), (day(2), "B")], "date date, symbol string")
    curve = point_in_time_curve(panel, bench, members, (1,), 1, every=2, cost_bps=0.0)
    equal = curve.filter("strategy = 'equal_weight'").orderBy("i").collect()
    assert [round(r["turnover"], 9) for r in equal] == [0, 1, 0, 2, 0, 0]
    broken = panel.filter(~((F.col("symbol") == "B") & (F.col("session") == F.lit(day(4)))))
    with pytest.raises(CoverageError, match="2020-01-05:B"):
        point_in_time_curve(broken, bench, members, (1,), 1, every=2)


def brute_metrics(points):
    import statistics as st
    e, b = [p[0] for p in points], [p[1] for p in points]
    r = [y / x - 1 for x, y in zip(e, e[1:])]
    m = [y / x - 1 for x, y in zip(b, b[1:])]
    act = [x - y for x, y in zip(r, m)]
    k = max(1, -(-len(r) * 5 // 100))
    worst = sorted(r)[:k]
    mb = st.fmean(m)
    up = [(x, y) for x, y in zip(r, m) if y > 0]
    return {
        "total_return": e[-1] / e[0] - 1, "volatility": st.stdev(r) * 252 ** 0.5,
        "sharpe": st.fmean(r) / st.stdev(r) * 252 ** 0.5,
        "information_ratio": st.fmean(act) / st.stdev(act) * 252 ** 0.5,
        "beta": sum((x - st.fmean(r)) * (y - mb) for x, y in zip(r, m)) / sum((y - mb) ** 2 for y in m),
        "value_at_risk_95": -worst[-1], "expected_shortfall_95": -st.fmean(worst),
        "max_drawdown": min(min(v / max(e[: i + 1]) - 1 for i, v in enumerate(e)), 0.0),
        "upside_capture": st.fmean(x for x, _ in up) / st.fmean(y for _, y in up),
        "daily_benchmark_win_rate": sum(x > 0 for x in act) / len(act), "decision_dates": len(e) - 1,
    }


def test_metrics_against_plain_formulas(spark):
    rng = random.Random(5)
    points = [(100.0, 100.0)]
    for _ in range(70):
        points.append((points[-1][0] * rng.uniform(0.97, 1.035), points[-1][1] * rng.uniform(0.98, 1.022)))
    table = spark.createDataFrame(
        [("s", day(i), e, b, 0.0) for i, (e, b) in enumerate(points)],
        "strategy string, session date, equity double, benchmark_equity double, cost double")
    row = metrics.performance_metrics(table, ["strategy"]).first()
    for name, value in brute_metrics(points).items():
        assert row[name] == pytest.approx(value, rel=1e-9), name


def test_holding_period_rates_and_degenerate_curves(spark):
    schema = "strategy string, session date, equity double, benchmark_equity double, cost double"
    table = spark.createDataFrame(
        [("a", day(0), 100.0, 100.0, 0.0), ("a", day(1), 110.0, 105.0, 0.0), ("a", day(2), 99.0, 100.0, 0.0),
         ("flat", day(0), 1.0, 1.0, 0.0), ("flat", day(1), 1.0, 1.0, 0.0), ("one", day(0), 1.0, 1.0, 0.0)], schema)
    rows = {r["strategy"]: r for r in metrics.performance_metrics(table, ["strategy"], 1).collect()}
    assert (rows["a"]["positive_1_session_rate"], rows["a"]["benchmark_win_1_session_rate"]) == (0.5, 0.5)
    assert rows["a"]["evaluated_1_session_periods"] == 2
    for name in ("flat", "one"):
        assert all(rows[name][c] == 0 for c in ("sharpe", "beta", "information_ratio", "calmar", "sortino", "upside_capture"))


def test_ranked_momentum_needs_history_and_breaks_ties_by_symbol(spark):
    rows = series("B", [100, 110, 121]) + series("A", [100, 110, 121]) + series("C", [100, 90, 80]) + series("D", [100, 130, 300])
    panel = bars(spark, rows)
    schedule = curves.rebalance_calendar(panel.select("session"), 1)
    found = strategies.ranked_momentum_targets(strategies.decision_panel(panel, schedule, (2,)), (2,), 2).collect()
    assert {(r["decision"], r["symbol"], r["position"], r["weight"]) for r in found} == {
        (day(2), "D", 1, 0.5), (day(2), "A", 2, 0.5)}


def test_stage_boundaries_share_a_point(spark):
    points = spark.createDataFrame([("s", i) for i in range(100)], "strategy string, i int")
    bounds = {r["stage"]: (r["start_i"], r["end_i"]) for r in strategies.stages(points, 0, (30, 15)).collect()}
    assert bounds == {"development": (0, 60), "validation": (59, 80), "holdout": (79, 100)}
    sliced = strategies.slice_stages(points, strategies.stages(points, 0, (30, 15)))
    assert sliced.filter("i = 59").count() == 2 and sliced.count() == 102


def test_comparison_selects_on_development_only(spark):
    n = 100
    rows = [bar(s, i, 100 * g ** i) for s, g in (("A", 1.002), ("B", 1.001)) for i in range(n)]
    bench = bars(spark, [bar("M", i, 100 * 1.0005 ** i * (1 + 0.001 * (i % 3))) for i in range(n)])
    result = compare.compare_candidates(bars(spark, rows), bench, (5,)).collect()
    assert len(result) == 6 and sum(r["selected"] for r in result) == 3
    assert {r["stage"] for r in result} == {"development", "validation", "holdout"}
