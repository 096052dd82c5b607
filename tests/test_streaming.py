"""Streaming jobs equal the batch result across restarts, and repeat safely."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from helpers import bar, bars, series
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.streaming import jobs, seen, sinks
from tidemark.streaming.seen import SeenIds
from tidemark.streaming.sinks import put_batch, put_state, read_batches, read_state
from tidemark.plans.streaming_queries import drain


def test_ingest_drops_repeats_across_restarts_and_quarantines(spark):
    good, again = [bar("A", i, 10) for i in range(4)], [bar("A", 1, 10), bar("A", 4, 11)]
    broken = bars(spark, [bar("B", 0, 10)]).withColumn("volume", F.lit(-1).cast("bigint"))
    parts = [bars(spark, good + [good[0]]), bars(spark, again).unionByName(broken)]
    out = drain(spark, parts, jobs.ingest_bars)
    assert read_batches(spark, f"{out}/bars", parts[0].schema).count() == 5
    assert spark.read.parquet(f"{out}/quarantine").select("symbol").first()[0] == "B"


def test_late_state_is_flagged_and_does_not_move_the_entity(spark):
    t = datetime(2025, 1, 1)
    schema = "user bigint, ts timestamp_ntz, event_id bigint, state string"
    first = spark.createDataFrame([(1, t, 1, "CANDIDATE"), (1, t + timedelta(hours=2), 2, "APPROVED")], schema)
    second = spark.createDataFrame([(1, t + timedelta(hours=1), 3, "OPEN"), (1, t + timedelta(hours=3), 4, "ORDER_PENDING")], schema)
    out = drain(spark, [first, second], lambda s, o, c: jobs.lifecycle_monitor(s, "user", ("ts", "event_id"), o, c))
    rows = {r["event_id"]: (r["legal"], r["late"]) for r in spark.read.parquet(f"{out}/audit").collect()}
    assert rows == {1: (True, False), 2: (True, False), 3: (False, True), 4: (True, False)}


def test_positions_continue_over_batches(spark):
    rows = [("P", "A", f"f{i}", i, "BUY" if i % 3 else "SELL", 3.0 if i % 3 else 2.0, 10.0 + i, 0.1) for i in range(1, 40)]
    schema = "portfolio string, symbol string, fill_id string, t int, side string, quantity double, price double, fee double"
    whole = ledger.positions(spark.createDataFrame(rows, schema), ["t"]).first()
    parts = [spark.createDataFrame(rows[a:b], schema) for a, b in ((0, 10), (10, 11), (11, 39))]
    out = drain(spark, parts, lambda s, o, c: jobs.running_positions(s, ("t",), o, c))
    row = jobs.latest_state(spark, out, jobs.HELD_STATE, ("portfolio", "symbol")).first()
    assert row["fills"] == whole["fills"] == 39
    for name in ("quantity", "cost_basis", "realized_pnl"):
        assert row[name] == pytest.approx(whole[name], rel=1e-9)


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1,), (2,)], "x int")
    for _ in range(2):
        put_batch(rows, path, 0)
    assert read_batches(spark, path, "x int").count() == 2


def test_state_is_the_newest_row_of_each_key_over_whole_tables_and_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "WHOLE_EVERY", 3)
    path, schema, held = str(tmp_path / "state"), "k int, v int", {}
    assert read_state(spark, path, schema, ["k"], 0).count() == 0
    for number in range(8):
        changed = {number % 4: number, None: -number}
        for _ in range(2 if number in (3, 4) else 1):
            known = read_state(spark, path, schema, ["k"], number)
            put_state(known, spark.createDataFrame(list(changed.items()), schema), path, ["k"], number)
        held |= changed
        found = read_state(spark, path, schema, ["k"], number + 1).collect()
        assert len(found) == len(held) and {r["k"]: r["v"] for r in found} == held
    assert [spark.read.parquet(f"{path}/batch={n}").count() for n in (5, 6)] == [2, 5]


def test_repeated_and_late_fills_are_placed(spark):
    schema = "portfolio string, symbol string, fill_id string, t int, side string, quantity double, price double, fee double"
    first = [("P", "A", "b", 2, "BUY", 10.0, 10.0, 0.0), ("P", "A", "c", 3, "SELL", 5.0, 20.0, 0.0)]
    second = [("P", "A", "a", 1, "BUY", 10.0, 20.0, 0.0), first[0]]
    whole = ledger.positions(spark.createDataFrame([*first, second[0]], schema), ["t"]).first()
    out = drain(spark, [spark.createDataFrame(rows, schema) for rows in (first, second)],
                lambda s, o, c: jobs.running_positions(s, ("t",), o, c))
    row = jobs.latest_state(spark, out, jobs.HELD_STATE, ("portfolio", "symbol")).first()
    assert [row[c] for c in ("fills", "quantity", "cost_basis", "realized_pnl")] == [
        whole[c] for c in ("fills", "quantity", "cost_basis", "realized_pnl")] == [3, 15.0, 225.0, 25.0]


def test_completeness_over_batches_and_empty_sessions(spark):
    day = lambda n, h=22: datetime(2025, 3, n, h)
    bars_of = lambda *rows: spark.createDataFrame([(s, day(n).date(), day(o)) for s, n, o in rows], "symbol string, session date, observed_at timestamp")
    universe = spark.createDataFrame([(day(n).date(), day(n), ["A", "B"]) for n in (1, 2, 3, 20)], "session date, closed_at timestamp_ntz, symbols array<string>")
    parts = [bars_of(("A", 1, 1), ("A", 3, 3)), bars_of(("B", 1, 2), ("A", 20, 20)), bars_of(("B", 2, 21))]
    out = drain(spark, parts, lambda s, o, c: jobs.session_completeness(s, universe, o, c))
    found = {r["session"].day: (r["seen"], r["missing"]) for r in jobs.completeness_report(spark, out).collect()}
    assert found == {1: (2, ""), 2: (0, "A,B"), 3: (1, "B")}
    late = read_batches(spark, f"{out}/late", "symbol string, session date, observed_at timestamp").collect()
    assert [(r["symbol"], r["session"].day) for r in late] == [("B", 2)]


def test_a_bar_with_other_content_is_listed(spark):
    first, other = bars(spark, series("A", [10, 11])), bars(spark, series("A", [10, 12]))
    out = drain(spark, [first, other], jobs.ingest_bars)
    assert sorted(r["close"] for r in read_batches(spark, f"{out}/bars", first.schema).collect()) == [10, 11]
    assert [r["close"] for r in read_batches(spark, f"{out}/conflicts", first.schema).collect()] == [12]


FILL = "portfolio string, symbol string, fill_id string, t int, side string, quantity double, price double, fee double"


def test_positions_over_many_batches_read_what_they_need(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jobs, "PERIOD_DAYS", 2)
    monkeypatch.setattr(jobs, "FILL_BUCKETS", 2)
    rng = random.Random(4)
    days = [[("P", s, f"{s}{t}{k}", t, "BUY" if s == "C" else rng.choice(["BUY", "BUY", "SELL"]), float(rng.randrange(1, 6)), 10.0 + rng.random(), 0.1)
             for s in "ABC" for k in range(2)] for t in range(20)]
    late, again = days[5].pop(), days[3][0]
    changed = (*days[16][1][:6], 99.0, 0.1)
    batches = [list(rows) for rows in days]
    batches[12].append(late)
    batches[9].append(again)
    batches[17] += [changed, changed, days[17][0]]
    # Two contents of one id in one batch: the least counts.
    twice = [("P", "D", "d", 18, "BUY", 1.0, price, 0.0) for price in (7.0, 8.0)]
    batches[18] += twice
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, FILL).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(FILL).option("maxFilesPerTrigger", 1).parquet(landing)
    jobs.running_positions(stream, ("t", "fill_id"), out, str(tmp_path / "checkpoint")).awaitTermination()
    held = jobs.latest_state(spark, out, jobs.HELD_STATE, ("portfolio", "symbol"))
    kept = next(row for row in twice if row[6] == held.filter("symbol = 'D'").first()["cost_basis"])
    whole = [row for rows in days for row in rows] + [late, kept]
    right = {r["symbol"]: r for r in ledger.positions(spark.createDataFrame(whole, FILL), ["t", "fill_id"]).collect()}
    found = {r["symbol"]: r for r in held.collect()}
    assert set(found) == set(right) == set("ABCD")
    for symbol, row in right.items():
        assert [found[symbol][c] for c in ("fills", "oversold_by")] == [row[c] for c in ("fills", "oversold_by")]
        for c in ("quantity", "cost_basis", "realized_pnl"):
            assert found[symbol][c] == pytest.approx(row[c], rel=1e-9, abs=1e-9)
    clash = read_batches(spark, f"{out}/conflicts", FILL).collect()
    assert sorted((r["fill_id"], r["price"]) for r in clash) == sorted([(changed[2], 99.0), ("d", 15.0 - kept[6])])
    reads = {}
    for r in read_batches(spark, f"{out}/reads", "bucket int, from_period bigint").collect():
        reads.setdefault(r["batch"], []).append(r["from_period"])
    # A batch in order goes on from its own period; the late fill goes back to its own, whatever came before.
    assert all(min(reads[n]) >= n // 2 for n in reads if n not in (0, 12, 18) and None not in reads[n])
    assert min(reads[12]) == 5 // 2
    costs = {r["batch"]: r["folders"] for r in SeenIds(f"{out}/ids").costs(spark).collect()}
    assert [n for n in sorted(costs) if costs[n]] == [9, 17]


def test_filters_grow_and_miss_no_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "FIRST_BITS", 1 << 10)
    store = SeenIds(str(tmp_path / "ids"))
    stored = {}
    for number in range(6):
        fresh = {f"id{number}-{k}": f"c{number}" for k in range(60)}
        asked = [*fresh, *list(stored)[::7], None]
        found = store.find(spark.createDataFrame([(i,) for i in asked], "id string"), number)
        assert {r["id"]: r["content"] for r in found.stored.collect()} == {i: stored[i] for i in asked if i in stored}
        store.add(spark.createDataFrame([*fresh.items(), (None, "x")], "id string, content string"), number, found)
        stored |= fresh
    made = read_batches(spark, f"{store.path}/made", seen.MADE).collect()
    assert max(r["generation"] for r in made) == 2 and sum(r["ids"] for r in made) == 360


def test_a_filter_moves_one_word_per_id_and_fits_its_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "FIRST_BITS", 1 << 10)
    store = SeenIds(str(tmp_path / "ids"))
    ids = spark.createDataFrame([(f"id{k}", "c") for k in range(500)], "id string, content string")
    store.add(ids, 0, store.find(ids.select("id"), 0))
    words = read_batches(spark, f"{store.path}/words", seen.WORDS)
    assert words.count() <= 500
    # A batch larger than the first filter has one of its own size, so new ids of the next are told apart without reading.
    new = spark.createDataFrame([(f"new{k}",) for k in range(5)], "id string")
    assert store.find(new, 1).folders == 0


def test_repeats_move_whole_rows_once_and_a_few_words_tell_known_buckets(spark, tmp_path, monkeypatch):
    """What a batch judges is written once, as the stored fills, and its shuffles take no more than two moves of the rows."""
    fills = [("P", f"S{k % 5}", f"f{k}", k, "BUY" if k % 3 else "SELL", 2.0 + k % 3, 10.0 + k, 0.1) for k in range(400)]
    changed = [(*row[:6], 99.0, 0.1) for row in fills[::40]]
    parts = [spark.createDataFrame(fills[:300], FILL), spark.createDataFrame(fills[100:] + changed, FILL)]
    asked = []
    hits = seen._hits
    monkeypatch.setattr(seen, "_hits", lambda probes, words: asked.append(hits(probes, words)) or asked[-1])
    monkeypatch.setattr(seen, "BUCKETS", 2)
    monkeypatch.setattr(seen, "FIRST_OF", 2)
    tables = []
    through = jobs.through_table
    monkeypatch.setattr(jobs, "through_table", lambda df, name: tables.append(name) or through(df, name))
    out = drain(spark, parts, lambda s, o, c: jobs.running_positions(s, ("t",), o, c))
    assert "fills-judged" not in tables
    # The first words asked name both buckets, so that the others are not asked.
    assert asked == [{(0, 0), (0, 1)}]
    found = spark.read.parquet(f"{out}/fills").filter("NOT clashes").collect()
    assert sorted(r["fill_id"] for r in found) == sorted(row[2] for row in fills)
    assert sorted(r["fill_id"] for r in read_batches(spark, f"{out}/conflicts", FILL).collect()) == sorted(row[2] for row in changed)
    right = {r["symbol"]: r for r in ledger.positions(spark.createDataFrame(fills, FILL), ["t"]).collect()}
    for row in jobs.latest_state(spark, out, jobs.HELD_STATE, ("portfolio", "symbol")).collect():
        assert [row[c] for c in ("fills", "oversold_by")] == [right[row["symbol"]][c] for c in ("fills", "oversold_by")]
        assert row["cost_basis"] == pytest.approx(right[row["symbol"]]["cost_basis"], rel=1e-9)
