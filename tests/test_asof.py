"""As-of joins, membership and calendar lookups."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from helpers import bar, bars, day
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.sources.membership import expand_members


def events(n, keys, seed, name):
    rng = random.Random(seed)
    start = datetime(2020, 1, 1)
    return [(rng.choice(keys), start + timedelta(minutes=rng.randrange(0, 20_000)), f"{name}{i}") for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("way", ["table", "scan", "split scan"])
def test_as_of_join_matches_brute_force(spark, direction, way):
    left, right = events(150, ["a", "a", "a", "b", "z"], 1, "q"), events(60, ["a", "b", "c"], 2, "f")
    left.append((right[0][0], right[0][1], "tie"))
    asked = spark.createDataFrame(left, "k string, t timestamp_ntz, q string")
    known = spark.createDataFrame(right, "k string, seen timestamp_ntz, f string")
    joined = asof.as_of_join(
        asked, known, ["k"], "t", "seen", direction, max_group_rows=20 if way == "split scan" else 10 ** 6,
        max_table_rows=10 ** 6 if way == "table" else 0)
    found = {r["q"]: r["match"]["f"] if r["match"] else None for r in joined.collect()}
    for key, at, name in left:
        if direction == "backward":
            options = [(t, f) for k, t, f in right if k == key and t <= at]
            best = max(options)[1] if options else None
        else:
            options = [(t, f) for k, t, f in right if k == key and t >= at]
            best = min(options)[1] if options else None
        assert found[name] == best
    assert len(found) == len(left)


def test_as_of_join_with_nothing_on_the_right(spark):
    asked = spark.createDataFrame([("a", datetime(2020, 1, 1))], "k string, t timestamp_ntz")
    known = spark.createDataFrame([], "k string, seen timestamp_ntz, f string")
    assert asof.as_of_join(asked, known, ["k"], "t", "seen").first()["match"] is None


def test_latest_within_rejects_old_and_future_values(spark):
    at = datetime(2020, 3, 20)
    asked = spark.createDataFrame([(s, at) for s in "abc"], "symbol string, at timestamp_ntz")
    caps = spark.createDataFrame([
        ("a", at - timedelta(days=1), 100.0), ("a", at - timedelta(days=3), 5.0), ("b", at - timedelta(days=11), 300.0),
        ("c", at + timedelta(minutes=1), 1000.0), ("c", at - timedelta(days=3), 200.0)],
        "symbol string, available timestamp_ntz, cap double")
    found = asof.latest_within(asked, caps, ["symbol"], "at", "available", F.make_dt_interval(F.lit(10)))
    assert {r["symbol"]: r["match"]["cap"] if r["match"] else None for r in found.collect()} == {"a": 100.0, "b": None, "c": 200.0}


def test_membership_spelling_and_intervals(spark):
    records = spark.createDataFrame([
        (date(2020, 1, 1), " A,B,OLD-202002,BF.B,A"), (date(2020, 6, 1), "A")], "date date, tickers string")
    members = expand_members(records)
    dates = spark.createDataFrame([(date(2019, 12, 31),), (date(2020, 5, 31),), (date(2020, 6, 1),)], "as_of date")
    found = {}
    for r in asof.members_on(dates, members).collect():
        found.setdefault(r["as_of"], set()).add(r["symbol"])
    assert found[date(2019, 12, 31)] == {None}
    assert found[date(2020, 5, 31)] == {"A", "B", "OLD", "BF-B"}
    assert found[date(2020, 6, 1)] == {"A"}
    spans = {(r["symbol"], r["valid_from"]): r["valid_to"] for r in asof.membership_spans(members).collect()}
    assert spans[("B", date(2020, 1, 1))] == date(2020, 6, 1) and spans[("A", date(2020, 6, 1))] is None


def test_coverage_lists_what_is_missing(spark):
    members = spark.createDataFrame([(day(0), "A"), (day(1), "B")], "date date, symbol string")
    sessions = spark.createDataFrame([(day(i),) for i in range(3)], "session date")
    table = bars(spark, [bar("A", 0, 10), bar("B", 1, 10)])
    audit = asof.coverage_audit(sessions, members, table).first()
    assert (audit["eligible"], audit["covered"], audit["approved"]) == (3, 2, False)
    assert [(r["session"], r["symbol"]) for r in asof.missing_prices(sessions, members, table).collect()] == [(day(2), "B")]


def test_calendar_lookup(spark):
    calendar = spark.createDataFrame([
        (day(i), datetime(2020, 1, 1 + i, 14, 30), datetime(2020, 1, 1 + i, 21)) for i in (0, 1, 5)],
        "session date, open_at timestamp_ntz, close_at timestamp_ntz")
    times = spark.createDataFrame([
        (0, datetime(2020, 1, 1, 20)), (1, datetime(2020, 1, 1, 21)), (2, datetime(2020, 1, 4)), (3, datetime(2020, 1, 9))],
        "n int, at timestamp_ntz")
    found = {r["n"]: (r["latest_session"], r["next_session"]) for r in asof.latest_closed(times, "at", calendar).collect()}
    assert found == {0: (None, None), 1: (day(0), day(1)), 2: (day(1), day(5)), 3: (None, None)}


def test_filing_after_the_decision_is_ignored(spark):
    facts = spark.createDataFrame([
        ("X", "Revenues", "USD", date(2025, 1, 2), "2024-12-31", "10", "10-Q"),
        ("X", "Revenues", "USD", date(2025, 4, 1), "2025-03-31", "99", "10-Q"),
        ("X", "Assets", "USD", date(2025, 1, 5), "2024-12-31", "7", "10-K")],
        "symbol string, concept string, unit string, filed date, end string, val string, form string")
    decisions = spark.createDataFrame([("X", date(2025, 2, 1)), ("X", date(2024, 1, 1))], "symbol string, decision_on date")
    found = asof.filing_evidence(facts, decisions, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).collect()
    assert len(found) == 1
    assert found[0]["claim"] == ("Revenues=10 (10-Q, period ended 2024-12-31); Assets=7 (10-K, period ended 2024-12-31)")
    assert found[0]["available_to_strategy_at"] == datetime(2025, 1, 5, 12)


def test_snapshot_completeness_states(spark):
    table = bars(spark, [bar("A", 0, 1), bar("A", 1, 1), bar("B", 0, 1), bar("B", 1, 1, available=datetime(2020, 2, 1))])
    closed = datetime(2020, 1, 2, 21)
    requests = spark.createDataFrame([
        ("ok", day(1), closed, closed, ["A"]), ("late bar", day(1), closed, closed, ["A", "B", "C"]),
        ("early", day(1), closed, datetime(2020, 1, 2, 20), ["A"]), ("none", day(1), closed, closed, [])],
        "request_id string, session date, decision_at timestamp_ntz, run_at timestamp_ntz, symbols array<string>")
    found = {r["request_id"]: (r["status"], r["missing"]) for r in asof.snapshot_completeness(requests, table).collect()}
    assert found["ok"] == ("COMPLETE", []) and found["late bar"] == ("INCOMPLETE", ["B", "C"])
    assert found["early"][0] == "BEFORE_CUTOFF" and found["none"][0] == "EMPTY_UNIVERSE"


@pytest.mark.parametrize("table_rows", [10**6, 0])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_null_keys_and_times_match_nothing(spark, table_rows, direction):
    t = lambda n: datetime(2025, 1, n)
    left = spark.createDataFrame([(1, "A", t(5)), (2, None, t(5)), (3, "A", None), (4, "B", t(5)), (5, "A", t(5))], "n int, k string, at timestamp_ntz")
    right = spark.createDataFrame([("A", t(4), 8.0), ("A", t(6), 9.0), (None, t(5), 7.0), ("A", None, 6.0), ("B", None, 5.0), ("A", t(4), 8.5)],
                                  "k string, known timestamp_ntz, v double")
    found = asof.as_of_join(left, right, ["k"], "at", "known", direction, max_table_rows=table_rows)
    value = 8.5 if direction == "backward" else 9.0
    assert {r["n"]: r["match"] and r["match"]["v"] for r in found.collect()} == {1: value, 2: None, 3: None, 4: None, 5: value}
