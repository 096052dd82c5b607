"""Payload parsing, membership files, stored bars, snapshots and the event log."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from helpers import bar, bars, series

from tidemark.sources import commits, membership, payloads, stores

NOW = datetime(2026, 1, 1)


def landed(spark, *rows):
    return spark.createDataFrame([(s, p if p is None or isinstance(p, str) else json.dumps(p), NOW) for s, p in rows],
                                 "symbol string, payload string, retrieved_at timestamp_ntz")


def test_list_prices_keep_raw_close_and_fill_gaps(spark):
    tuesday = {"date": "2023-08-15T00:00:00.000Z", "open": 7.5, "high": 8.25, "low": 7, "close": 8, "adjClose": 4, "volume": None,
               "divCash": 0.04, "splitFactor": None}
    good, cut_off = json.dumps([tuesday]), json.dumps([tuesday])[:60]
    frame = landed(spark, ("qrst", good), ("gone", {"detail": "unknown symbol"}), ("empty", {"rows": 0}), ("half", cut_off), ("none", None))
    (row,) = payloads.parse_list_prices(frame).collect()
    assert (row["symbol"], row["session"], row["volume"]) == ("QRST", date(2023, 8, 15), 0)
    assert [float(row[c]) for c in ("close", "adjusted_close", "dividend", "split_coefficient")] == [8, 8, 0.04, 1]
    assert row["available_to_strategy_at"] == datetime(2023, 8, 15, 21) and row["vintage"].startswith("raw:retrieved:2026-01-01")
    reasons = {r["symbol"]: r["reason"] for r in payloads.quarantine(frame, payloads.list_error()).collect()}
    assert reasons == {"gone": "unknown symbol", "empty": '{"rows": 0}', "half": "not valid JSON", "none": "no response"}


def numbered_bar(*values, names):
    return {f"{k}. {name}": str(value) for k, (name, value) in enumerate(zip(names, values, strict=True), 1)}


def test_map_prices_adjusted_raw_and_errors(spark):
    plain = ("open", "high", "low", "close")
    whole = {payloads.SERIES: {"2022-05-31": numbered_bar(
        20, 24.5, 19, 22, 5.5, 1300, "0.11", "4", names=(*plain, "adjusted close", "volume", "dividend amount", "split coefficient"))}}
    bare = {payloads.SERIES: {"2022-05-31": numbered_bar(20, 24.5, 19, 22, 1300, names=(*plain, "volume"))}}
    odd = {payloads.SERIES: {"2022-05-31": numbered_bar(20, 24.5, 19, 22, "many", names=(*plain, "volume"))}}
    (row,) = payloads.parse_map_prices(landed(spark, ("w", whole), ("slow", {"Information": "wait"}))).collect()
    assert [float(row[c]) for c in ("adjusted_close", "dividend", "split_coefficient")] == [5.5, 0.11, 4]
    bars_ = landed(spark, ("b", bare), ("o", odd))
    rows = {r["symbol"]: r for r in payloads.parse_map_prices(bars_, adjusted=False).collect()}
    assert float(rows["B"]["adjusted_close"]) == 22 and rows["B"]["volume"] == 1300 and float(rows["B"]["dividend"]) == 0
    assert set(rows) == {"B"}
    assert [tuple(r) for r in payloads.rejected_map_prices(bars_, adjusted=False).collect()] == [("O", "2022-05-31", "volume", "many", "not a whole number")]
    frame = landed(spark, ("slow", {"Note": "wait"}), ("both", {"Error Message": "no such name", "Information": "later"}), ("bare", {"about": "nothing"}),
                   ("cut", json.dumps(bare)[:50]), ("fine", bare))
    reasons = {r["symbol"]: r["reason"] for r in payloads.quarantine(frame, payloads.map_error()).collect()}
    assert reasons == {"slow": "wait", "both": "no such name", "bare": "daily series missing", "cut": "daily series missing"}


def test_caps_facts_tickers_and_universe(spark):
    caps = landed(spark, ("v", [{"date": "2023-02-01T", "marketCap": 5_000_000}, {"date": "2023-02-02", "marketCap": None}]), ("w", '[{"date": "2023'))
    assert [(r["symbol"], float(r["market_cap"])) for r in payloads.parse_market_caps(caps).collect()] == [("V", 5e6)]
    assert [r["symbol"] for r in payloads.quarantine(caps, payloads.list_error()).collect()] == ["w"]
    filings = [{"val": 31, "form": "10-K", "filed": "2023-02-20", "end": "2022-12-31"}, {"val": 32, "form": "S-1", "filed": "2023-03-01"}, {"val": 33, "form": "10-Q"}]
    facts = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": filings}}, "Unlisted": {"units": {"USD": filings[:1]}}}}}
    frame = landed(spark, ("V", facts), ("W", json.dumps(facts)[:-9]), ("X", {"cik": 1}))
    assert [(r["concept"], r["val"]) for r in payloads.parse_company_facts(frame).collect()] == [("Revenues", "31")]
    assert {r["symbol"]: r["reason"] for r in payloads.quarantine(frame, payloads.facts_error()).collect()} == {"W": "not valid JSON", "X": "facts missing"}
    tickers = landed(spark, ("", {"9": {"cik_str": 4321, "ticker": "uv.w"}}))
    assert [tuple(r) for r in payloads.parse_ticker_map(tickers).collect()] == [("UV-W", 4321)]
    lists = [{"as_of": "2023-06-30", "count": n, "symbols": names} for n, names in ((3, ["U", "V", "W"]), (3, ["U", "V"]), (2, ["U", "U"]))]
    assert [r["valid"] for r in payloads.parse_universe_snapshot(landed(spark, *[("", x) for x in lists])).collect()] == [True, False, False]


def test_membership_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "members.csv"
    path.write_text('﻿date,tickers\n2019-03-04,"M,N,LEFT-201907,O.P"\n', encoding="utf-8")
    found = {r["symbol"] for r in membership.read_membership_csv(spark, str(path)).collect()}
    assert found == {"M", "N", "LEFT", "O-P"}
    path.write_text("day,names\n2020-01-01,A\n", encoding="utf-8")
    with pytest.raises(ValueError, match="header"):
        membership.read_membership_csv(spark, str(path))


def test_landed_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "Note": "x"\n}', encoding="utf-8")
    rows = payloads.read_landed(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and json.loads(rows[0]["payload"]) == {"Note": "x"}


def test_bar_store_prunes_years(spark, tmp_path):
    path = str(tmp_path / "bars")
    stores.write_bars(bars(spark, series("A", [10] * 800)), path)
    part = stores.read_bars(spark, path, "2021-02-01", "2021-02-10")
    assert part.count() == 10
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_writing_bars_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "again")
    for rows in (series("A", [10, 11]), series("A", [10, 11]), series("B", [5]), series("A", [10, 11, 12])):
        stores.write_bars(bars(spark, rows), path)
    assert spark.read.parquet(path).groupBy("symbol").count().toPandas().set_index("symbol")["count"].to_dict() == {"A": 3, "B": 1}


def test_covering_range_prefers_the_narrowest(spark):
    schema = "symbol string, cached_start date, cached_end date"
    cached = spark.createDataFrame([("A", date(2020, 1, 1), date(2025, 1, 1)), ("A", date(2021, 1, 1), date(2022, 1, 1))], schema)
    asked = spark.createDataFrame([("A", date(2021, 2, 1), date(2021, 3, 1)), ("A", date(2021, 2, 1), date(2026, 3, 1)), ("B", date(2021, 2, 1), date(2021, 3, 1))],
                                  "symbol string, start date, end date")
    found = {(r["symbol"], r["end"]): (r["covered"], r["cached_end"]) for r in stores.covering_range(asked, cached).collect()}
    assert found == {("A", date(2021, 3, 1)): (True, date(2022, 1, 1)), ("A", date(2026, 3, 1)): (False, None), ("B", date(2021, 3, 1)): (False, None)}


def test_snapshot_is_frozen_once(spark, tmp_path):
    path, table = str(tmp_path / "snap"), bars(spark, series("A", [10, 11]) + series("B", [5]))
    first = stores.freeze_snapshot(table, path, "s", "2021-01-01 00:00:00")
    assert stores.freeze_snapshot(table.orderBy("close"), path, "s", "2021-01-01 00:00:00") == first
    assert spark.read.parquet(f"{path}/rows").count() == 3
    with pytest.raises(stores.SnapshotConflict):
        stores.freeze_snapshot(bars(spark, series("A", [10, 12])), path, "s", "2021-01-01 00:00:00")
    assert {(r["symbol"], r["close"]) for r in stores.read_snapshot(spark, path, "s").collect()} == {("A", 10.0), ("A", 11.0), ("B", 5.0)}
    with pytest.raises(KeyError):
        stores.read_snapshot(spark, path, "t")
    with pytest.raises(ValueError, match="became available"):
        stores.freeze_snapshot(bars(spark, [bar("A", 0, 1, available=datetime(2030, 1, 1))]), path, "t", "2021-01-01 00:00:00")


def test_event_log_counts_first_delivery(spark):
    schema = "delivery int, event_id string, occurred_at timestamp_ntz, event_type string, entity_id string, payload string"
    rows = [(0, "a", NOW, "T", "e", "1"), (1, "a", NOW, "T", "e", "2"), (0, "b", NOW, "T", "e", "1"), (0, "c", NOW, "T", "f", "1")]
    incoming = spark.createDataFrame(rows, schema)
    stored = stores.with_payload_hash(spark.createDataFrame([(0, "b", NOW, "T", "e", "9"), (0, "d", NOW, "T", "e", "1")], schema))
    found = {r["event_id"]: (r["outcome"], r["contradicts"], r["payload"]) for r in stores.classify_events(incoming, stored).collect()}
    assert found == {"a": ("NEW", True, "1"), "b": ("CONFLICT", False, "1"), "c": ("NEW", False, "1")}
    log = stores.sequenced(stores.append_events(incoming, stored))
    assert [(r["sequence"], r["event_id"]) for r in stores.entity_events(log, "e").collect()] == [(1, "a")]


def test_results_are_verified(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "case_id int, verdict string")
    stored = stores.hashed_results(rows, ["case_id"])
    assert stores.verify_results(stored, ["case_id"]).count() == 0
    changed = stores.hashed_results(spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "case_id int, verdict string"), ["case_id"])
    found = {r["case_id"]: r["outcome"] for r in stores.result_conflicts(stored, changed, "case_id").collect()}
    assert found == {1: "SAME", 2: "CONFLICT", 3: "NEW"}


def test_report_is_written_with_sorted_fields(spark, tmp_path):
    stores.write_report(spark.createDataFrame([(2.0, "s", 1)], "zeta double, name string, alpha int"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"alpha":1,"name":"s","zeta":2.0}'


def test_each_bad_field_is_rejected_with_its_reason(spark):
    good = {"date": "2023-08-15T00:00:00.000Z", "open": 7, "high": 8, "low": 6, "close": 7.5}
    items = [good, good | {"date": "2001-13-45"}, good | {"close": "1O1", "volume": "n/a"}, {"date": None, "open": "NaN"} | {k: 1 for k in ("high", "low", "close")},
             good | {"volume": "", "divCash": "x", "splitFactor": ""}, 5, good | {"open": 10 ** 15}]
    frame = landed(spark, ("l", items))
    assert [r["volume"] for r in payloads.parse_list_prices(frame).collect()] == [0]
    found = {(r["place"], r["field"]): (r["value"], r["reason"]) for r in payloads.rejected_list_prices(frame).collect()}
    assert found.pop(("1", "session")) == ("2001-13-45", "not a date")
    assert found.pop(("2", "close")) == ("1O1", "not a number") and found.pop(("2", "volume")) == ("n/a", "not a whole number")
    assert found.pop(("3", "session")) == (None, "missing") and found.pop(("3", "open")) == ("NaN", "not a number")
    assert found.pop(("4", "dividend")) == ("x", "not a number")
    assert found.pop(("6", "open")) == ("1000000000000000", "not a number")
    assert set(found) == {("5", f) for f in ("session", "open", "high", "low", "close")} and set(found.values()) == {(None, "missing")}

    plain = ("open", "high", "low", "close", "volume")
    days = {"2022-05-31": numbered_bar(1, 2, 1, 2, 5, names=plain), "2001-01-32": numbered_bar(1, 2, 1, 2, 5, names=plain),
            "2022-06-01": numbered_bar(1, 2, 1, 2, names=plain[:4]), "2022-06-02": numbered_bar(1, "", 1, 2, "13.5", names=plain)}
    frame = landed(spark, ("m", {payloads.SERIES: days}))
    assert [str(r["session"]) for r in payloads.parse_map_prices(frame, adjusted=False).collect()] == ["2022-05-31"]
    assert {(r["place"], r["field"], r["reason"]) for r in payloads.rejected_map_prices(frame, adjusted=False).collect()} == {
        ("2001-01-32", "session", "not a date"), ("2022-06-01", "volume", "missing"), ("2022-06-02", "high", "missing"), ("2022-06-02", "volume", "not a whole number")}
    assert {r["field"] for r in payloads.rejected_map_prices(frame).collect()} >= {"adjusted_close", "dividend", "split_coefficient"}

    caps = landed(spark, ("v", [{"date": "n/a", "marketCap": 5}, {"date": "2023-02-02", "marketCap": "big"}, {"date": "2023-02-03", "marketCap": 7}]))
    assert [float(r["market_cap"]) for r in payloads.parse_market_caps(caps).collect()] == [7]
    assert {(r["field"], r["reason"]) for r in payloads.rejected_market_caps(caps).collect()} == {("observed_date", "not a date"), ("market_cap", "not a number")}

    filings = [{"val": 1, "form": "10-K", "filed": "2001-02-30"}, {"val": "x", "form": "10-Q", "filed": "2001-02-28"}, {"val": 2, "form": "10-Q", "filed": "2001-02-28"}]
    facts = landed(spark, ("V", {"facts": {"us-gaap": {"Assets": {"units": {"USD": filings}}}}}))
    assert [r["val"] for r in payloads.parse_company_facts(facts).collect()] == ["2"]
    assert {(r["place"], r["field"]) for r in payloads.rejected_company_facts(facts).collect()} == {("Assets/USD/0", "filed"), ("Assets/USD/1", "val")}

    tickers = landed(spark, ("", {"0": {"cik_str": "x1", "ticker": "a"}, "1": {"cik_str": 7, "ticker": None}, "2": {"cik_str": 8, "ticker": "b"}}))
    assert [tuple(r) for r in payloads.parse_ticker_map(tickers).collect()] == [("B", 8)]
    assert {(r["place"], r["field"], r["reason"]) for r in payloads.rejected_tickers(tickers).collect()} == {("0", "cik", "not a whole number"), ("1", "ticker", "missing")}

    whole = {"as_of": "2023-06-30", "count": 1, "symbols": ["U"]}
    universes = landed(spark, ("", whole), ("", json.dumps(whole)[:30]), ("", whole | {"as_of": "2023-06-31"}), ("", whole | {"count": "many"}),
                       ("", whole | {"symbols": ["U", None]}), ("", {"as_of": "2023-06-30"}), ("", [1]), ("", None))
    assert [r["valid"] for r in payloads.parse_universe_snapshot(universes).collect()] == [True]
    assert sorted(r["field"] for r in payloads.rejected_universes(universes).collect()) == ["as_of", "count", "symbols"]
    assert sorted(r["reason"] for r in payloads.quarantine(universes, payloads.universe_error()).collect()) == [
        "count missing", "no response", "not an object", "not valid JSON"]


def test_a_changed_snapshot_is_not_read(spark, tmp_path):
    path = str(tmp_path / "snap")
    digest = stores.freeze_snapshot(bars(spark, series("A", [10, 11])), path, "a/b", "2021-01-01 00:00:00")
    bars(spark, series("A", [10, 12])).write.mode("overwrite").parquet(f"{path}/rows/digest={digest}")
    with pytest.raises(stores.SnapshotConflict):
        stores.read_snapshot(spark, path, "a/b")


def test_one_of_two_writers_commits(spark, tmp_path):
    path = str(tmp_path / "x" / "0.json")
    assert commits.read_commit(spark, path) is None
    assert commits.create_once(spark, path, {"a": 1}) and not commits.create_once(spark, path, {"a": 2})
    assert commits.read_commit(spark, path) == {"a": 1} and commits.listed(spark, str(tmp_path / "x")) == ["0.json"]


def test_numbers_of_the_log_go_on(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    schema = "delivery int, event_id string, occurred_at timestamp_ntz, event_type string, entity_id string, payload string"
    batch = lambda *ids: spark.createDataFrame([(0, i, NOW, "T", "e", f"p{i}") for i in ids], schema)
    assert stores.read_log(spark, path).count() == 0
    assert [stores.append_log(batch("b", "a"), path), stores.append_log(batch("a", "c", "d"), path), stores.append_log(batch("a", "c", "d"), path)] == [2, 2, 0]
    assert [(r["sequence"], r["event_id"]) for r in stores.read_log(spark, path).orderBy("sequence").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    found = stores._log_commits(spark, path)
    monkeypatch.setattr(stores, "_log_commits", lambda spark, path: found[:1])
    with pytest.raises(stores.ConcurrentAppend):
        stores.append_log(batch("z"), path)
    monkeypatch.undo()
    assert stores.read_log(spark, path).count() == 4


def test_covering_range_of_many_ranges(spark):
    rng = random.Random(9)
    day = lambda n: date(1999, 1, 1) + timedelta(days=n)
    ranges = sorted({(a, a + rng.randrange(400)) for a in (rng.randrange(9000) for _ in range(10_000))})
    asked = sorted({(a, a + rng.randrange(300)) for a in (rng.randrange(9000) for _ in range(1_000))}) + [ranges[5]]
    cached = spark.createDataFrame([("A", day(a), day(b)) for a, b in ranges] + [("B", day(9), day(8))], "symbol string, cached_start date, cached_end date")
    requests = spark.createDataFrame([("A", day(a), day(b)) for a, b in asked] + [("B", day(8), day(8)), ("C", None, day(1))], "symbol string, start date, end date")
    found = stores.covering_range(requests, cached)
    assert not any(name in found._jdf.queryExecution().optimizedPlan().toString() for name in ("Join Inner", "Cartesian"))
    best = {(r["start"], r["end"]): (r["cached_start"], r["cached_end"]) for r in found.filter("symbol = 'A'").collect()}
    starts, ends = (np.array(x) for x in zip(*ranges, strict=True))
    for a, b in asked:
        fits = np.flatnonzero((starts <= a) & (ends >= b))
        narrow = min(((ends[k] - starts[k], starts[k], ends[k]) for k in fits), default=None)
        assert best[day(a), day(b)] == ((None, None) if narrow is None else (day(int(narrow[1])), day(int(narrow[2]))))
    assert [r["covered"] for r in found.filter("symbol <> 'A'").collect()] == [False, False]


def test_responses_are_judged_on_stored_bars(spark):
    from tidemark.plans import sources_queries

    # Over lazy bars, the check of a response made of keys alone ran once per trade.
    for query in (sources_queries.rejected_fields, sources_queries.accepted_items, sources_queries.quarantined_responses):
        assert "l_shipdate" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
