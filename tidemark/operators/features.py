"""Price features over a point-in-time panel.

All windows of a symbol share one (symbol, session) ordering, so a panel costs one shuffle. A
symbol's partition is bounded by the calendar: (symbol, session) is unique (``duplicate_sessions``
checks it), so even a hot symbol has at most one row per trading day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.columns import (
    TRADING_DAYS, canonical, dbl, r, running_set_hash, scaled, sorted_list_hash,
)
from tidemark.operators.quality import eligible

FEATURE_VERSION = "price-features-v1"
MOMENTUM_LOOKBACKS = (21, 63, 126, 252)
FEATURES = (
    "average_dollar_volume_21d", "beta_63d", "maximum_drawdown",
    "momentum_126d", "momentum_21d", "momentum_252d", "momentum_63d",
    "realized_volatility_21d", "realized_volatility_63d", "relative_strength_63d",
)


def by_symbol():
    return W.partitionBy("symbol").orderBy("session")


def up_to_now():
    return by_symbol().rowsBetween(W.unboundedPreceding, 0)


def simple_return(column: str = "close", window=None) -> Column:
    return dbl(column) / F.lag(dbl(column)).over(window or by_symbol()) - 1


def momentum(lookback: int, column: str = "close", window=None) -> Column:
    """Change over ``lookback`` sessions; null until there are lookback + 1 bars."""
    return dbl(column) / F.lag(dbl(column), lookback).over(window or by_symbol()) - 1


def realized_volatility(sessions: int, column: str = "daily_return", window=None) -> Column:
    """Annualised sample deviation of the last returns; shorter history allowed, null below two."""
    return F.stddev_samp(column).over((window or by_symbol()).rowsBetween(-(sessions - 1), 0)) * math.sqrt(TRADING_DAYS)


def running_drawdown(value: str = "close", peak: str = "peak", window=None) -> Column:
    return F.least(F.lit(0.0), F.min(dbl(value) / F.col(peak) - 1).over(window or up_to_now()))


def average_dollar_volume(sessions: int = 21, window=None) -> Column:
    return F.avg(dbl("close") * dbl("volume")).over((window or by_symbol()).rowsBetween(-(sessions - 1), 0))


def bar_text() -> Column:
    """Canonical text of the inputs a feature depends on."""
    return canonical([
        F.col("symbol"), F.col("session"), scaled("close"), F.col("volume"),
        F.date_format("available_to_strategy_at", "yyyy-MM-dd HH:mm:ss"), F.col("vintage"),
    ])


def one_per_session(benchmark: DataFrame, *columns: str) -> DataFrame:
    """Benchmark columns renamed bench_*; grouped by date, so the side is bounded by the calendar."""
    return benchmark.filter(F.col("quality") == "PASS").groupBy("session").agg(*[
        F.max(column).alias(f"bench_{column}") for column in columns])


def with_price_features(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Feature columns for every bar, computed from it and the symbol's earlier bars in the input.

    The benchmark is joined before any lag, so benchmark returns span the stock's own consecutive
    sessions and are null where either end has no benchmark bar.
    """
    bench = F.broadcast(one_per_session(benchmark, "close", "available_to_strategy_at"))
    joined = bars.join(bench, "session", "left")
    daily = joined.select(
        "*",
        simple_return().alias("daily_return"),
        simple_return("bench_close").alias("bench_return"),
        F.max(dbl("close")).over(up_to_now()).alias("peak"),
        bar_text().alias("_bar_text"),
    ).withColumn("paired", F.col("bench_return").isNotNull() & F.col("daily_return").isNotNull()).withColumn(
        "pair_number", F.count_if("paired").over(up_to_now()))
    last_pairs = W.partitionBy("symbol").orderBy("pair_number").rangeBetween(-62, 0)
    pair = lambda name: F.when(F.col("paired"), F.col(name))
    return daily.select(
        "*",
        *[momentum(k).alias(f"momentum_{k}d") for k in MOMENTUM_LOOKBACKS],
        *[realized_volatility(k).alias(f"realized_volatility_{k}d") for k in (21, 63)],
        running_drawdown().alias("maximum_drawdown"),
        (momentum(63) - momentum(63, "bench_close")).alias("relative_strength_63d"),
        average_dollar_volume().alias("average_dollar_volume_21d"),
        F.count("*").over(up_to_now()).alias("bars_seen"),
        running_set_hash(F.col("_bar_text"), up_to_now()).alias("input_digest"),
    ).withColumn("beta_63d", F.regr_slope(pair("daily_return"), pair("bench_return")).over(last_pairs))


def features_as_of(bars: DataFrame, benchmark: DataFrame, decision_at: Column) -> DataFrame:
    """One snapshot per symbol for one decision time, with the SHA-256 of every input bar.

    The availability filter stands before the windows: it would not be pushed through them.
    Symbols with fewer than two usable bars give no row.
    """
    usable = eligible(bars, decision_at)
    latest = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("session")))
    panel = with_price_features(usable, eligible(benchmark, decision_at)).withColumn("latest", latest)
    snapshots = panel.filter("latest = 1 AND bars_seen >= 2").select(
        "symbol", F.col("session").alias("as_of"), F.lit(FEATURE_VERSION).alias("feature_version"), *FEATURES)
    hashes = usable.groupBy("symbol").agg(sorted_list_hash(bar_text()).alias("input_hash"))
    return snapshots.join(hashes, "symbol").withColumn("created_at", decision_at)


def feature_panel(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every session as a decision, in one pass.

    Row (symbol, s) is what a decision at ``created_at`` sees, where created_at is the time by which
    all bars up to s had arrived. Rows that a later bar overtook before that time are left out:
    a decision then would already be dated by the later bar. So each row equals a snapshot taken
    at its created_at, without comparing every bar with every decision.
    """
    panel = with_price_features(bars.filter(F.col("quality") == "PASS"), benchmark)
    arrived = F.greatest("available_to_strategy_at", "bench_available_to_strategy_at")
    later = by_symbol().rowsBetween(1, W.unboundedFollowing)
    return panel.select(
        "*", F.max(arrived).over(up_to_now()).alias("created_at"),
        F.min("available_to_strategy_at").over(later).alias("next_arrival"),
    ).filter("bars_seen >= 2 AND (next_arrival IS NULL OR next_arrival > created_at)").select(
        "symbol", F.col("session").alias("as_of"), "created_at",
        F.lit(FEATURE_VERSION).alias("feature_version"), "input_digest", *FEATURES)


def return_factor(window=None) -> Column:
    """Growth of one session with splits and the cash dividend; 1 on the first bar."""
    previous = F.lag(dbl("close")).over(window or by_symbol())
    factor = dbl("split_coefficient") * (dbl("close") + dbl("dividend")) / previous
    return F.coalesce(factor, F.lit(1.0))


def with_growth(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds the running total-return growth and the bar number inside each key."""
    window = W.partitionBy(*keys).orderBy("session")
    seen = window.rowsBetween(W.unboundedPreceding, 0)
    return bars.withColumn("factor", return_factor(window)).select(
        "*", F.product("factor").over(seen).alias("growth"), (F.row_number().over(window) - 1).alias("i"))


def total_return(lookback: int, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """Total-return growth over ``lookback`` sessions (needs with_growth); null on short history.

    Rounded to 12 places, so that an unchanged price is exactly 1 in the strict comparisons.
    """
    window = W.partitionBy(*keys).orderBy("session")
    return F.round(F.col("growth") / F.lag("growth", lookback).over(window), 12)


def _packet_columns(lookbacks: tuple[int, ...], volatility: int) -> list[Column]:
    span = by_symbol().rowsBetween(-(volatility - 1), 0)
    return [
        *[r(total_return(k) - 1, 8).alias(f"momentum_{k}") for k in lookbacks],
        r(F.stddev_pop("daily_return").over(span) * math.sqrt(TRADING_DAYS), 8).alias("volatility_63"),
    ]


def ranker_packet(bars: DataFrame, lookbacks: tuple[int, ...] = MOMENTUM_LOOKBACKS, volatility: int = 62) -> DataFrame:
    """Anonymous candidate table of the last bar of every symbol with a full history.

    Total-return momentum and the population deviation of the last ``volatility`` price returns;
    ids are numbered in symbol order (one row per symbol reaches the numbering).
    """
    last = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("session")))
    rows = with_growth(bars).withColumn("daily_return", simple_return()).select(
        "symbol", "session", "i", *_packet_columns(lookbacks, volatility), last.alias("last"))
    latest = rows.filter((F.col("last") == 1) & (F.col("i") >= max(lookbacks)))
    number = F.row_number().over(W.orderBy("symbol"))
    return latest.withColumn("id", F.format_string("asset_%03d", number)).drop("last", "i")


def ranker_packets(
    bars: DataFrame, decisions: DataFrame, lookbacks: tuple[int, ...] = MOMENTUM_LOOKBACKS, volatility: int = 62,
) -> DataFrame:
    """The same table at every decision session (``decisions`` has one row per date: decision)."""
    rows = with_growth(bars).withColumn("daily_return", simple_return()).select(
        "symbol", "session", "i", *_packet_columns(lookbacks, volatility)).filter(F.col("i") >= max(lookbacks))
    at = rows.join(F.broadcast(decisions), rows.session == F.col("decision"))
    number = F.row_number().over(W.partitionBy("decision").orderBy("symbol"))
    return at.withColumn("id", F.format_string("asset_%03d", number)).drop("session", "i")
