"""Point-in-time features: no future data, panel rows equal snapshots, short histories."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from helpers import bar, bars, close_of, day, series
from pyspark.sql import functions as F

from tidemark.operators import features, quality


def stamp(at):
    return F.lit(at).cast("timestamp_ntz")


def test_future_and_failing_bars_are_excluded(spark):
    table = bars(spark, series("A", [100, 110]) + [bar("A", 2, 500, available=datetime(2021, 1, 1)), bar("A", 3, 900, quality="STALE")])
    row = features.features_as_of(table, table, stamp(datetime(2020, 6, 1))).first()
    assert row["as_of"] == day(1) and row["average_dollar_volume_21d"] == pytest.approx(105e6)
    again = features.features_as_of(table, table, stamp(datetime(2020, 6, 1))).first()
    assert row["input_hash"] == again["input_hash"]
    later = features.features_as_of(table, table, stamp(datetime(2021, 6, 1))).first()
    assert later["as_of"] == day(2) and later["input_hash"] != row["input_hash"]


def test_one_bar_gives_no_snapshot_and_lookback_needs_one_more_bar(spark):
    one = bars(spark, series("A", [100]))
    assert features.features_as_of(one, one, stamp(datetime(2021, 1, 1))).count() == 0
    closes = [100.0 + i for i in range(22)]
    table = bars(spark, series("A", closes))
    row = features.features_as_of(table, table, stamp(datetime(2021, 1, 1))).first()
    assert row["momentum_21d"] == pytest.approx(closes[-1] / closes[0] - 1) and row["momentum_63d"] is None
    short = features.features_as_of(bars(spark, series("A", closes[1:])), table, stamp(datetime(2021, 1, 1))).first()
    assert short["momentum_21d"] is None and short["realized_volatility_63d"] is not None


def test_panel_rows_equal_snapshots_taken_at_their_time(spark):
    rng = random.Random(2)
    rows, market = [], []
    price = {"A": 100.0, "B": 80.0}
    for i in range(80):
        for s in price:
            price[s] *= rng.uniform(0.95, 1.06)
            if rng.random() < 0.9:
                late = timedelta(days=rng.choice([0, 0, 0, 4]))
                rows.append(bar(s, i, price[s], available=close_of(day(i)) + late, quality="STALE" if rng.random() < 0.05 else "PASS"))
        if rng.random() < 0.9:
            market.append(bar("M", i, 100 * rng.uniform(0.9, 1.1)))
    table, bench = bars(spark, rows), bars(spark, market)
    panel = features.feature_panel(table, bench).collect()
    for r in rng.sample(panel, 6):
        shot = features.features_as_of(table.filter(F.col("symbol") == r["symbol"]), bench, stamp(r["created_at"])).first()
        assert shot["as_of"] == r["as_of"]
        for name in features.FEATURES:
            assert shot[name] == (pytest.approx(r[name], rel=1e-9, abs=1e-12) if r[name] is not None else None), name


def test_benchmark_return_spans_the_stocks_own_sessions(spark):
    table = bars(spark, [bar("A", 0, 100), bar("A", 2, 110), bar("A", 3, 121)])
    bench = bars(spark, series("M", [50, 999, 55, 44]))
    rows = {r["session"]: r for r in features.with_price_features(table, bench).collect()}
    assert rows[day(2)]["bench_return"] == pytest.approx(0.1) and rows[day(3)]["bench_return"] == pytest.approx(-0.2)


def test_ranker_packet_hides_names_and_needs_full_history(spark):
    rows = [bar(s, i, 100 * g ** i) for s, g in (("ZED", 1.001), ("ABLE", 1.002)) for i in range(254)] + series("NEW", [1.0] * 200)
    packet = {r["symbol"]: r for r in features.ranker_packet(bars(spark, rows)).collect()}
    assert {s: r["id"] for s, r in packet.items()} == {"ABLE": "asset_001", "ZED": "asset_002"}
    assert packet["ABLE"]["momentum_252"] == pytest.approx(1.002 ** 252 - 1, abs=1e-8)


def test_bar_rules_name_every_fault(spark):
    good = bars(spark, series("A", [10]))
    bad = good.withColumn("low", F.lit(11.0)).withColumn("volume", F.lit(-1).cast("bigint")).withColumn(
        "published_at", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    valid, invalid = quality.split_valid(good.unionByName(bad), quality.bar_violations())
    assert valid.count() == 1
    assert invalid.first()["violations"] == ["volume_not_negative", "low_is_lowest", "published_before_available"]
    assert quality.duplicate_sessions(good.unionByName(good)).first()["copies"] == 2


def test_set_hash_of_a_growing_frame(spark):
    """Order does not matter; swapped, doubled and altered texts do; the width is that of SHA-256."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.functions.columns import running_set_hash

    groups = {"base": "abc", "turned": "cba", "doubled": "aabc", "altered": "abd", "short": "ab", "long": "abcabc"}
    rows = [(name, k, letter * 3) for name, letters in groups.items() for k, letter in enumerate(letters)]
    frame = spark.createDataFrame(rows, "name string, k int, text string")
    up = Window.partitionBy("name").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    found = {(r["name"], r["k"]): r["h"] for r in frame.select("name", "k", running_set_hash(F.col("text"), up).alias("h")).collect()}
    last = {name: found[name, len(letters) - 1] for name, letters in groups.items()}
    assert last["base"] == last["turned"] and len(set(last.values())) == 5
    assert found["base", 1] == last["short"] and all(len(h) == 64 for h in found.values())
    lanes = [sum(int(hashlib.sha256(t.encode()).hexdigest()[8 * k:8 * k + 8], 16) for t in ("aaa", "bbb", "ccc")) % 2**32 for k in range(8)]
    assert last["base"] == "".join(f"{lane:08x}" for lane in lanes)
