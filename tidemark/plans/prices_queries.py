"""Registered queries: bar checks, price features and total-return series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import joined, r
from tidemark.operators import curves, features, quality
from tidemark.plans import driver_tables as d

DECISION = "1999-06-30 00:00:00"


def decision():
    return F.lit(DECISION).cast("timestamp_ntz")


def panel(spark, sf):
    """Bars from the bar table and the index built from them: the trades are scanned once."""
    bars = d.stored_bars(spark, sf)
    return bars, d.benchmark_bars(bars)


def with_faults(bars):
    """Bars with planted faults for the validity rules."""
    volume = F.col("volume")
    return bars.withColumns({
        "low": F.when(volume % 17 == 0, F.col("high") + 1).otherwise(F.col("low")),
        "dividend": F.when(volume % 19 == 0, F.lit(-0.5)).otherwise(F.col("dividend")),
        "split_coefficient": F.when(volume % 23 == 0, F.lit(0.0)).otherwise(F.col("split_coefficient")),
        "published_at": F.when(volume % 29 == 0, F.date_add("session", 60).cast("timestamp_ntz"))
        .otherwise(F.col("published_at")),
    })


def bar_validity(spark, sf):
    _, bad = quality.split_valid(with_faults(d.bars(spark, sf)), quality.bar_violations())
    return bad.select("symbol", "session", joined("violations").alias("violations"))


def bars_at_decision(spark, sf):
    return quality.eligible(d.bars(spark, sf), decision()).select("symbol", "session", "close", "volume")


def duplicate_sessions(spark, sf):
    bars = d.bars(spark, sf).select("symbol", "session", "volume")
    return quality.duplicate_sessions(bars.unionByName(bars.filter("volume % 31 = 0"))).select(
        "symbol", "session", "copies")


def date_slice(spark, sf):
    return quality.date_slice(d.bars(spark, sf), "1996-01-01", "1996-02-20", 3)


def returns(spark, sf):
    return d.bars(spark, sf).select(
        "symbol", "session", r(features.simple_return()).alias("daily_return"))


def feature(name):
    def query(spark, sf):
        bars, bench = panel(spark, sf)
        return features.with_price_features(bars.filter("quality = 'PASS'"), bench).select(
            "symbol", "session", r(name).alias(name))
    return query


def momentum(spark, sf):
    bars = d.bars(spark, sf).filter("quality = 'PASS'")
    return bars.select("symbol", "session", *[
        r(features.momentum(k)).alias(f"momentum_{k}d") for k in features.MOMENTUM_LOOKBACKS])


def volatility(spark, sf):
    daily = d.bars(spark, sf).filter("quality = 'PASS'").withColumn("daily_return", features.simple_return())
    return daily.select("symbol", "session", *[
        r(features.realized_volatility(k)).alias(f"realized_volatility_{k}d") for k in (21, 63)])


def paired_returns(spark, sf):
    bars, bench = panel(spark, sf)
    thin = bench.filter(F.day("session") != 7)
    return features.with_price_features(bars.filter("quality = 'PASS'"), thin).filter("paired").select(
        "symbol", "session", r("daily_return").alias("daily_return"), r("bench_return").alias("bench_return"))


def rounded_features():
    return [r(name).alias(name) for name in features.FEATURES]


def feature_snapshot(spark, sf):
    bars, bench = panel(spark, sf)
    return features.features_as_of(bars, bench, decision()).select(
        "symbol", "as_of", "created_at", "feature_version", "input_hash", *rounded_features())


def feature_panel(spark, sf):
    bars, bench = panel(spark, sf)
    return features.feature_panel(bars, bench).select(
        "symbol", "as_of", "created_at", "feature_version", "input_digest", *rounded_features())


def total_return(spark, sf):
    return features.with_growth(d.bars(spark, sf)).select(
        "symbol", "session", r("growth").alias("growth"),
        *[r(features.total_return(k)).alias(f"growth_{k}") for k in (5, 21, 63)])


def ranker_packet(spark, sf):
    return features.ranker_packet(d.bars(spark, sf).filter("symbol <> 'Brand-7' OR session < date'1997-01-01'"))


def hold_value(spark, sf):
    return curves.buy_and_hold_value(d.bars(spark, sf)).select("symbol", "session", r("value").alias("value"))


def pairwise_alignment(spark, sf):
    bars, bench = panel(spark, sf)
    return curves.align(bars, bench.filter(F.month("session") != 8)).select(
        "symbol", "session", "close", "bench_open", "bench_close")


def common_sessions(spark, sf):
    bars, bench = panel(spark, sf)
    return curves.common_sessions(bars, bench)


QUERIES = {
    "bar_validity": bar_validity,
    "bars_at_decision": bars_at_decision,
    "duplicate_sessions": duplicate_sessions,
    "date_slice": date_slice,
    "simple_returns": returns,
    "price_momentum": momentum,
    "realized_volatility": volatility,
    "maximum_drawdown": feature("maximum_drawdown"),
    "rolling_beta": feature("beta_63d"),
    "relative_strength": feature("relative_strength_63d"),
    "average_dollar_volume": feature("average_dollar_volume_21d"),
    "benchmark_paired_returns": paired_returns,
    "feature_snapshot": feature_snapshot,
    "feature_panel": feature_panel,
    "total_return_growth": total_return,
    "ranker_packet": ranker_packet,
    "buy_and_hold_value": hold_value,
    "pairwise_alignment": pairwise_alignment,
    "common_sessions": common_sessions,
}
