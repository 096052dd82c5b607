"""Positions, cash, execution, orders and replay against plain loops."""

from __future__ import annotations

import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger

SMALL = "/root/testdata/sf0.001"
FILLS = "portfolio string, symbol string, fill_id string, t int, side string, quantity double, price double, fee double"


def loop_positions(rows):
    """Average cost, one fill at a time; a position stops at its first oversell."""
    state = {}
    for p, s, fid, _, side, q, price, fee in sorted(rows, key=lambda r: r[3]):
        x = state.setdefault((p, s), {"q": 0.0, "basis": 0.0, "pnl": 0.0, "n": 0, "bad": None})
        if x["bad"]:
            continue
        if side == "BUY":
            x["q"] += q
            x["basis"] += q * price + fee
        elif q > x["q"] + 1e-9:
            x["bad"] = fid
            continue
        else:
            relieved = x["basis"] / x["q"] * q
            x["pnl"] += q * price - fee - relieved
            x["q"] -= q
            x["basis"] -= relieved
            if abs(x["q"]) < 1e-9:
                x["q"] = x["basis"] = 0.0
        x["n"] += 1
    return state


def random_fills(seed, n=500):
    rng, held, rows = random.Random(seed), {}, []
    for i in range(n):
        key = ("P", rng.choice(["hot", "hot", "hot", "B", "C"]))
        have = held.get(key, 0.0)
        if have and rng.random() < 0.45:
            q = have if rng.random() < 0.2 else round(rng.uniform(0.1, 1.0) * have, 3)
            if rng.random() < 0.004:
                q = have + 5
            side, held[key] = "SELL", have - q
        else:
            q = float(rng.randrange(1, 50))
            side, held[key] = "BUY", have + q
        rows.append((*key, f"f{i}", i, side, q, round(rng.uniform(10, 90), 2), 0.5))
    return rows


@pytest.mark.parametrize("limit", [10 ** 6, 40])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_positions_match_the_loop_with_and_without_split(spark, limit, seed):
    rows = random_fills(seed)
    found = ledger.positions(spark.createDataFrame(rows, FILLS), ["t"], max_group_rows=limit).collect()
    expected = loop_positions(rows)
    assert len(found) == len(expected)
    for r in found:
        x = expected[(r["portfolio"], r["symbol"])]
        assert (r["fills"], r["oversold_by"]) == (x["n"], x["bad"])
        assert r["quantity"] == pytest.approx(x["q"], abs=1e-6)
        assert r["cost_basis"] == pytest.approx(x["basis"], rel=1e-8, abs=1e-5)
        assert r["realized_pnl"] == pytest.approx(x["pnl"], rel=1e-8, abs=1e-4)


def test_round_trip_and_long_holding(spark):
    rows = [("P", "A", "1", 1, "BUY", 10.0, 100.0, 1.0), ("P", "A", "2", 2, "SELL", 10.0, 110.0, 1.0)]
    rows += [("P", "B", f"b{i}", i, "BUY" if i % 2 == 0 else "SELL", 10.0 if i % 2 == 0 else 9.0, 10.0, 0.0) for i in range(400)]
    found = {r["symbol"]: r for r in ledger.positions(spark.createDataFrame(rows, FILLS), ["t"]).collect()}
    assert found["A"]["quantity"] == 0 and found["A"]["realized_pnl"] == pytest.approx(98.0)
    expected = loop_positions(rows)[("P", "B")]
    assert found["B"]["cost_basis"] == pytest.approx(expected["basis"], rel=1e-9)


def test_cash_names_the_first_overdraft(spark):
    rows = [("P", "A", "1", 1, "BUY", 5.0, 10.0, 1.0), ("P", "A", "2", 2, "BUY", 10.0, 10.0, 0.0), ("P", "A", "3", 3, "SELL", 15.0, 10.0, 0.0)]
    for limit in (10 ** 6, 1):
        row = ledger.cash_ledger(spark.createDataFrame(rows, FILLS), ["t"], 100.0, max_group_rows=limit).first()
        assert (row["cash"], row["lowest_cash"], row["overdrawn_by"]) == (99.0, -51.0, "2")


ORDER = ("order_id string, portfolio string, symbol string, side string, quantity double, earliest_execution_at timestamp_ntz, "
         "max_position_weight double")
QUOTE = ("symbol string, observed_at timestamp_ntz, available_at timestamp_ntz, mid double, spread_bps double, "
         "available_quantity double, halted boolean")


def test_execution_prices_partials_and_reasons(spark):
    at = datetime(2025, 1, 3)
    orders = spark.createDataFrame([
        ("buy", "P", "A", "BUY", 10.0, at, 1.0), ("sell", "P", "A", "SELL", 10.0, at, 1.0), ("part", "P", "B", "BUY", 10.0, at, 1.0),
        ("halt", "P", "C", "BUY", 1.0, at, 1.0), ("dry", "P", "D", "BUY", 1.0, at, 1.0), ("none", "P", "E", "BUY", 1.0, at, 1.0)], ORDER)
    quotes = spark.createDataFrame([
        ("A", datetime(2025, 1, 2), datetime(2025, 1, 2), 50.0, 0.0, 99.0, False), ("A", at, at, 100.0, 10.0, 99.0, False),
        ("B", at, at, 100.0, 10.0, 4.0, False), ("C", at, at, 100.0, 10.0, 4.0, True), ("D", at, at, 100.0, 10.0, 0.0, False),
        ("E", datetime(2025, 1, 2), datetime(2025, 1, 2), 1.0, 0.0, 1.0, False)], QUOTE)
    found = {r["order_id"]: r for r in ledger.execute(ledger.match_quotes(orders, quotes), 1.0, 5.0).collect()}
    assert found["buy"]["price"] == pytest.approx(100.10) and found["sell"]["price"] == pytest.approx(99.90)
    assert (found["part"]["status"], found["part"]["quantity"], found["part"]["residual"]) == ("PARTIAL", 4.0, 6.0)
    assert found["buy"]["spread_cost"] == pytest.approx(0.5) and found["buy"]["slippage_cost"] == pytest.approx(0.5)
    assert {n: found[n]["reason"] for n in ("halt", "dry", "none")} == {
        "halt": "instrument halted", "dry": "no executable liquidity", "none": "no quote"}


def test_orders_from_targets(spark):
    targets = spark.createDataFrame([("P", "A", 0.10), ("P", "NEW", 0.5)], "portfolio string, symbol string, weight double")
    held = spark.createDataFrame([("P", "OLD", 5.0), ("P", "GONE", 2.0)], "portfolio string, symbol string, quantity double")
    marks = spark.createDataFrame([("A", 100.0), ("OLD", 1.5)], "symbol string, mark double")
    equity = spark.createDataFrame([("P", 10_000.0)], "portfolio string, portfolio_value double")
    found = {r["symbol"]: r for r in ledger.orders_from_targets(targets, held, marks, equity, "s1").collect()}
    assert set(found) == {"A", "GONE"}
    assert (found["A"]["order_id"], found["A"]["quantity"]) == ("s1:P:A:BUY", 10.0)
    assert found["GONE"]["outcome"] == "MISSING_MARK"


def test_replay_applies_each_order_once(spark):
    def event(seq, kind, entity, **body):
        return (seq, kind, entity, json.dumps(body))
    order = {"portfolio": "P", "symbol": "A", "side": "BUY", "quantity": 1.0, "price": 5.0, "fee": 0.0, "status": "FILLED"}
    log = spark.createDataFrame([
        event(1, ledger.FROZEN, "s1", decision_at="t0"),
        event(2, ledger.QUEUED, "s1", order_id="o1", submitted_at="t0", **order),
        event(3, ledger.QUEUED, "s1", order_id="o1", submitted_at="t0", **order),
        event(4, ledger.QUEUED, "s1", order_id="o2", submitted_at="t9", **order),
        event(5, ledger.QUEUED, "s2", order_id="o3", submitted_at="t0", **order),
        event(6, ledger.RESULT, "s1", order_id="o1", **order), event(7, ledger.RESULT, "s1", order_id="o1", **order),
        event(8, ledger.RESULT, "s1", order_id="o2", **order)], "sequence bigint, event_type string, entity_id string, payload string")
    outcomes = ledger.replay(log)
    assert {r["sequence"]: r["outcome"] for r in outcomes.collect()} == {
        2: "QUEUED", 3: "DUPLICATE", 4: "WRONG_TIME", 5: "NOT_FROZEN", 6: "APPLIED", 7: "DUPLICATE", 8: "UNQUEUED"}
    assert [r["fill_id"] for r in ledger.replayed_fills(outcomes).collect()] == ["o1"]


def test_lifecycle_moves(spark):
    rows = [("x", i, s) for i, s in enumerate(["CANDIDATE", "APPROVED", "ORDER_PENDING", "OPEN", "CANDIDATE"])]
    states = spark.createDataFrame(rows, "entity string, t int, state string")
    for limit in (10 ** 6, 2):
        found = {r["t"]: r["legal"] for r in ledger.transition_audit(states, "entity", ["t"], limit).collect()}
        assert found == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_health_reasons(spark):
    jobs = spark.createDataFrame([("DEAD",), ("SUCCEEDED",)], "status string")
    none = spark.createDataFrame([], "created_at timestamp_ntz")
    now = F.lit("2025-01-10 00:00:00").cast("timestamp_ntz")
    assert {r["status"]: r["jobs"] for r in ledger.status_counts(jobs).collect()} == {
        "PENDING": 0, "RUNNING": 0, "SUCCEEDED": 1, "DEAD": 1}
    assert ledger.operational_health(jobs, none, now).first()["reasons"] == [
        "dead-letter jobs require review", "no successful data snapshot"]
    good = spark.createDataFrame([(datetime(2025, 1, 9),)], "created_at timestamp_ntz")
    assert ledger.operational_health(jobs.filter("status <> 'DEAD'"), good, now).first()["healthy"]


def test_valuation_counts_missing_marks(spark):
    fills = spark.createDataFrame(
        [("P", "A", "1", "BUY", 2.0, 10.0, 1.0, date(2025, 1, 1)), ("P", "B", "2", "BUY", 1.0, 5.0, 0.0, date(2025, 1, 1))],
        "portfolio string, symbol string, fill_id string, side string, quantity double, price double, fee double, session date")
    marks = spark.createDataFrame([("A", date(2025, 1, 1), 10.0), ("A", date(2025, 1, 2), 9.0)], "symbol string, session date, mark double")
    bench = spark.createDataFrame([(date(2025, 1, 1), 100.0), (date(2025, 1, 2), 101.0)], "session date, close double")
    held = ledger.daily_positions(fills, marks)
    rows = {r["session"]: r for r in ledger.valuations(held, ledger.cash_by_session(fills, 100.0), bench, 100.0, 100.0, marks).collect()}
    assert rows[date(2025, 1, 1)]["missing_marks"] == 1
    assert rows[date(2025, 1, 2)]["portfolio_value"] == pytest.approx(74 + 18)
    assert rows[date(2025, 1, 2)]["benchmark_return"] == pytest.approx(0.01)


def test_decimal_trades_end_flat_however_they_are_split(spark):
    rng = random.Random(9)
    sizes = [rng.randrange(1, 10**10) / 10**4 for _ in range(500)]
    sold = rng.sample(sizes, 500)
    rows = [("P", "A", f"f{i}", i, "BUY", q, 3.0, 0.0) for i, q in enumerate(sizes)]
    rows += [("P", "A", f"f{500 + i}", 500 + i, "SELL", q, 3.0, 0.0) for i, q in enumerate(sold)]
    rows += [("P", "A", f"f{1000 + i}", 1000 + i, "BUY", 10.0, 10.0, 0.0) for i in range(5)]
    fills = spark.createDataFrame(rows, "portfolio string, symbol string, fill_id string, t int, side string, quantity double, price double, fee double")
    for limit in (10**6, 700, 90, 20):
        row = ledger.positions(fills, ["t"], max_group_rows=limit).first()
        assert (row["quantity"], row["cost_basis"], row["fills"], row["oversold_by"], row["left_out"]) == (50.0, 500.0, 1005, None, 0)
        assert ledger.cash_ledger(fills, ["t"], 1e9, max_group_rows=limit).first()["cash"] == 1e9 - 500


def test_fills_after_a_short_sale_are_counted(spark):
    rows = [("P", "A", "a", 1, "BUY", 1.0, 5.0, 0.0), ("P", "A", "b", 2, "SELL", 2.0, 5.0, 0.0), ("P", "A", "c", 3, "BUY", 4.0, 5.0, 0.0)]
    fills = spark.createDataFrame(rows, "portfolio string, symbol string, fill_id string, t int, side string, quantity double, price double, fee double")
    row = ledger.positions(fills, ["t"]).first()
    assert (row["quantity"], row["fills"], row["oversold_by"], row["left_out"]) == (1.0, 1, "b", 2)


def test_weights_are_unknown_while_a_held_position_has_no_mark(spark):
    trades = [("P", "A", "1", "BUY", 2.0, 10.0, 0.0, 1), ("P", "B", "2", "BUY", 1.0, 5.0, 0.0, 1), ("P", "A", "3", "BUY", 1.0, 10.0, 0.0, 2),
              ("P", "B", "4", "SELL", 1.0, 5.0, 0.0, 3), ("P", "A", "5", "BUY", 1.0, 10.0, 0.0, 4)]
    fills = spark.createDataFrame([(*t[:7], date(2025, 1, t[7])) for t in trades],
                                  "portfolio string, symbol string, fill_id string, side string, quantity double, price double, fee double, session date")
    # B has no mark on the second day, and after the third day it is no longer held.
    marks = spark.createDataFrame([(s, date(2025, 1, n), 10.0 if s == "A" else 5.0) for s, n in (("A", 1), ("B", 1), ("A", 2), ("A", 3), ("B", 3), ("A", 4))],
                                  "symbol string, session date, mark double")
    buys = spark.createDataFrame([(f"o{n}", "P", "A", date(2025, 1, n), "BUY", 1.0, 0.5) for n in (1, 2, 3, 4)],
                                 "order_id string, portfolio string, symbol string, session date, side string, quantity double, max_position_weight double")
    found = ledger.weight_limit(buys, ledger.daily_positions(fills, marks), ledger.cash_by_session(fills, 100.0), 100.0).collect()
    rows = {r["order_id"]: (r["weight"], r["within_limit"], r["unmarked"]) for r in found}
    assert rows["o2"] == (None, None, 1)
    assert rows["o1"] == (pytest.approx(0.1), True, 0) and rows["o3"] == (pytest.approx(0.4), True, 0) and rows["o4"] == (pytest.approx(0.4), True, 0)


def test_closed_positions_have_no_rows_until_they_open_again(spark):
    day = lambda n: date(2025, 1, n)
    trades = [("P", "A", "BUY", 2.0, 5.0, 0.0, day(1)), ("P", "A", "SELL", 2.0, 5.0, 0.0, day(3)), ("P", "A", "BUY", 1.0, 5.0, 0.0, day(8)),
              ("P", "B", "BUY", 1.0, 5.0, 0.0, day(2)), ("P", "B", "SELL", 1.0, 5.0, 0.0, day(2)), ("Q", "A", "BUY", 3.0, 5.0, 0.0, day(9))]
    fills = spark.createDataFrame(trades, "portfolio string, symbol string, side string, quantity double, price double, fee double, session date")
    marks = spark.createDataFrame([(s, day(n), 10.0 + n) for s in "ABC" for n in range(1, 11) if (s, n) != ("A", 9)], "symbol string, session date, mark double")
    met = ledger.open_sessions(fills, marks.select("session"))
    # Open (position, session) pairs and the sessions that close a position; nothing else meets the marks.
    assert sorted((r["portfolio"], r["symbol"], r["session"].day, r["quantity"]) for r in met.collect()) == [
        ("P", "A", 1, 2.0), ("P", "A", 2, 2.0), ("P", "A", 3, 0.0), ("P", "A", 8, 1.0), ("P", "A", 9, 1.0), ("P", "A", 10, 1.0),
        ("P", "B", 2, 0.0), ("Q", "A", 9, 3.0), ("Q", "A", 10, 3.0)]
    held = ledger.daily_positions(fills, marks)
    assert {(r["portfolio"], r["session"].day): r["mark"] for r in held.filter("symbol = 'A' and session >= '2025-01-08'").collect()} == {
        ("P", 8): 18.0, ("P", 10): 20.0, ("Q", 9): None, ("Q", 10): 20.0}
    bench = spark.createDataFrame([(day(n), 100.0) for n in range(1, 11)], "session date, close double")
    found = ledger.valuations(held, ledger.cash_by_session(fills, 100.0), bench, 100.0, 100.0, marks).collect()
    value = {(r["portfolio"], r["session"].day): r["portfolio_value"] for r in found}
    assert len(value) == 12 and [value["P", n] for n in (1, 2, 3, 5, 8, 10)] == [112.0, 114.0, 100.0, 100.0, 113.0, 115.0]
    assert value["Q", 10] == 145.0
    assert ledger.daily_positions(fills.limit(0), marks).isEmpty()


def _replayed(events):
    """Outcome per (number, order, kind) of events (number, kind, order, in time) of frozen sessions, by a plain loop."""
    first, applied, out = {}, {}, []
    for seq, kind, order, timely in sorted(events, key=lambda e: (e[0], str(e))):
        if kind == ledger.QUEUED:
            if timely and order is not None:
                first[order] = min(first.get(order, seq), seq)
            out.append((seq, kind, order, "WRONG_TIME" if not timely else "DUPLICATE" if order is not None and seq > first[order] else "QUEUED"))
    for seq, kind, order, _ in sorted(events, key=lambda e: (e[0], str(e))):
        if kind == ledger.RESULT:
            follows = order in first and seq > first[order]
            if follows:
                applied.setdefault(order, seq)
            out.append((seq, kind, order, "UNQUEUED" if not follows else "DUPLICATE" if seq > applied[order] else "APPLIED"))
    return sorted(out, key=str)


def test_replay_of_repeats_and_ties_in_any_stretch(spark):
    rng = random.Random(4)
    orders = ["a", "b", "c", None]
    events = [(rng.randrange(10, 60), rng.choice([ledger.QUEUED, ledger.RESULT]), rng.choice(orders), rng.random() < 0.8) for _ in range(150)]
    body = lambda order, timely: json.dumps({"order_id": order, "submitted_at": "t0" if timely else "t1", "status": "FILLED"})
    log = [(1, ledger.FROZEN, "s", json.dumps({"decision_at": "t0"}))] + [(seq, kind, "s", body(order, timely)) for seq, kind, order, timely in events]
    table = spark.createDataFrame(log, "sequence bigint, event_type string, entity_id string, payload string")
    for limit in (10 ** 6, 20):
        found = ledger.replay(table, max_group_rows=limit).collect()
        assert sorted(((r["sequence"], r["event_type"], r["order_id"], r["outcome"]) for r in found), key=str) == _replayed(events)


def test_replay_moves_events_once(spark):
    from tidemark.plans import ledger_queries

    plan = ledger_queries.event_replay(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1
    # Fills of a replay are stored before positions count and scan them.
    plan = ledger_queries.replayed_positions(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.lower() and "jsontostructs" not in plan.lower()


def test_a_book_joins_its_fills_once(spark):
    from tidemark.plans import ledger_queries

    relations = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate#")
    scan = relations(spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_shipdate"))
    assert scan and relations(ledger_queries.target_orders(spark, SMALL)) == 0
    # Buys alone are read besides, and meet one table.
    plan = ledger_queries.weight_limits(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation" in line and "l_shipdate#" in line]) == 1 and plan.count("Join ") == 3
