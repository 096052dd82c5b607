"""Next-open return curves as window operators.

A decision made at a close trades at the next session's open. With 0/1 signals the whole curve of
one instrument is a product of daily factors; with periodic rebalances every holding period is a
weighted sum of per-symbol values, and periods are chained by a product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.columns import dbl
from tidemark.operators.features import return_factor, total_return
from tidemark.session import materialize

BUY_AND_HOLD = "buy_and_hold"
CASH = "cash"


def align(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Sessions that the symbol and the benchmark share, with the benchmark's prices.

    The benchmark side is grouped by date, which bounds it by the calendar.
    """
    bench = benchmark.groupBy("session").agg(*[
        F.max(dbl(name)).alias(f"bench_{name}") for name in ("open", "close", "dividend", "split_coefficient")])
    return bars.join(F.broadcast(bench), "session")


def common_sessions(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Sessions on which every symbol of the panel and the benchmark have a bar."""
    total = bars.agg(F.count_distinct("symbol").alias("symbols")).scalar()
    per_session = bars.groupBy("session").agg(F.count_distinct("symbol").alias("present"))
    complete = per_session.filter(F.col("present") == total)
    return complete.join(benchmark.select("session").distinct(), "session", "left_semi").select("session")


def hold_value(prefix: str = "", keys: Sequence[str] = ("symbol",)) -> Column:
    """Value of one unit of cash invested at the first open and held; dividends stay cash.

    The first session's own split and dividend do not apply: the position starts at its open.
    Needs the columns {prefix}shares and {prefix}income made by ``with_hold_columns``.
    """
    first = W.partitionBy(*keys).orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    start = F.first(dbl(f"{prefix}open")).over(first)
    return (F.col(f"{prefix}shares") * dbl(f"{prefix}close") + F.col(f"{prefix}income")) / start


def with_hold_columns(rows: DataFrame, prefix: str = "", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Shares per starting share and cumulated cash dividends, from the second session on."""
    order = W.partitionBy(*keys).orderBy("session")
    seen = order.rowsBetween(W.unboundedPreceding, 0)
    later = F.row_number().over(order) > 1
    split = F.when(later, dbl(f"{prefix}split_coefficient")).otherwise(F.lit(1.0))
    marked = rows.withColumn(f"{prefix}split_now", split).withColumn(f"{prefix}later", later)
    shares = marked.withColumn(f"{prefix}shares", F.product(f"{prefix}split_now").over(seen))
    paid = F.when(F.col(f"{prefix}later"), F.col(f"{prefix}shares") * dbl(f"{prefix}dividend")).otherwise(F.lit(0.0))
    return shares.withColumn(f"{prefix}paid", paid).withColumn(
        f"{prefix}income", F.sum(f"{prefix}paid").over(seen)).drop(
        f"{prefix}split_now", f"{prefix}later", f"{prefix}paid")


def buy_and_hold_value(bars: DataFrame) -> DataFrame:
    return with_hold_columns(bars).withColumn("value", hold_value())


def momentum_signal(lookback: int) -> Column:
    """1 where total return over the lookback is positive, 0 otherwise and on short history."""
    return F.when(total_return(lookback) > 1, F.lit(1.0)).otherwise(F.lit(0.0))


def candidate_signals(aligned: DataFrame, lookbacks: Sequence[int]) -> list[tuple[str, Column]]:
    """Named signals at each close: hold, stay in cash, and one momentum rule per lookback."""
    return [(BUY_AND_HOLD, F.lit(1.0)), (CASH, F.lit(0.0))] + [
        (f"momentum_{k}", momentum_signal(k)) for k in lookbacks]


def with_signals(aligned: DataFrame, lookbacks: Sequence[int]) -> DataFrame:
    """Total-return growth and one row per candidate with its signal (no extra shuffle)."""
    order = W.partitionBy("symbol").orderBy("session")
    seen = order.rowsBetween(W.unboundedPreceding, 0)
    grown = aligned.withColumn("factor", return_factor(order)).withColumn(
        "growth", F.product("factor").over(seen)).withColumn("i", F.row_number().over(order) - 1)
    signals = candidate_signals(grown, lookbacks)
    named = grown.select("*", *[value.alias(f"signal_{n}") for n, (_, value) in enumerate(signals)])
    pairs = F.array(*[
        F.struct(F.lit(name).alias("candidate"), F.col(f"signal_{n}").alias("signal"))
        for n, (name, _) in enumerate(signals)])
    kept = [c for c in grown.columns if c not in ("factor", "growth")]
    return named.select(*kept, F.explode(pairs).alias("pair")).select(*kept, "pair.candidate", "pair.signal")


def long_flat_curves(
    bars: DataFrame, benchmark: DataFrame, lookbacks: Sequence[int], cost_bps: float = 5.0,
    starting_cash: float = 1.0,
) -> DataFrame:
    """Equity and benchmark curves of every (symbol, candidate) in one lazy plan.

    The exchange on symbol also serves the (symbol, candidate) windows.
    """
    c = cost_bps / 10_000
    keys = ["symbol", "candidate"]
    signals = with_signals(with_hold_columns(align(bars, benchmark), "bench_"), lookbacks).withColumn(
        "benchmark_equity", F.lit(starting_cash) * hold_value("bench_", keys))
    order = W.partitionBy(*keys).orderBy("session")
    seen = order.rowsBetween(W.unboundedPreceding, 0)
    before, now = F.col("held_before"), F.col("held")
    previous = F.lag(dbl("close")).over(order)
    moves = signals.withColumns({
        "held": F.coalesce(F.lag("signal", 1).over(order), F.lit(0.0)),
        "held_before": F.coalesce(F.lag("signal", 2).over(order), F.lit(0.0)),
        "previous": previous,
    })
    op, cl, div, split = dbl("open"), dbl("close"), dbl("dividend"), dbl("split_coefficient")
    stay = (before == 1) & (now == 1)
    leave = (before == 1) & (now == 0)
    enter = (before == 0) & (now == 1)
    factor = (
        F.when(stay, split * (1 + div * (1 - c) / op) * cl / F.col("previous"))
        .when(leave, split * (div + op * (1 - c)) / F.col("previous"))
        .when(enter, (1 - c) * cl / op).otherwise(F.lit(1.0)))
    cost_rate = (
        F.when(stay, split * div * c / F.col("previous")).when(leave, split * op * c / F.col("previous"))
        .when(enter, F.lit(c)).otherwise(F.lit(0.0)))
    grown = moves.withColumn("day_factor", factor).withColumn("cost_rate", cost_rate).withColumn(
        "equity", F.lit(starting_cash) * F.product("day_factor").over(seen))
    return grown.select(
        *keys, "session", "i", F.col("held").alias("target"), "equity", "benchmark_equity",
        (F.col("cost_rate") * F.col("equity") / F.col("day_factor")).alias("cost"))


# ---------------------------------------------------------------- periodic rebalance

def rebalance_calendar(sessions: DataFrame, every: int) -> DataFrame:
    """Numbered sessions with the holding period each belongs to.

    Decisions fall on sessions 0, k, 2k, ... and execute at the next open. The table holds one row
    per trading day, so its single-partition window is bounded by the calendar.
    """
    order = W.orderBy("session")
    i = F.row_number().over(order) - 1
    numbered = sessions.select("session").distinct().select(
        "session", i.alias("i"), F.lead("session").over(order).alias("next_session"))
    return numbered.select(
        "session", "i", "next_session",
        (F.col("i") % every == 0).alias("decides"),
        F.when(F.col("i") % every == 0, (F.col("i") / every).cast("int")).alias("decision_period"),
        F.when(F.col("i") >= 1, F.floor((F.col("i") - 1) / every).cast("int")).alias("period"),
        ((F.col("i") - 1) % every == 0).alias("executes"),
    )


def _period_values(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Per (symbol, period): stock value and dividend cash of one invested unit at each close.

    A session that executes a rebalance is the last row of the old period (valued at the open,
    after its split and dividend) and the first row of the new one.
    """
    dated = panel.join(F.broadcast(schedule.filter("i >= 1")), "session")
    entry = F.struct(F.col("period").alias("period"), F.lit(False).alias("exit"))
    leaving = F.struct((F.col("period") - 1).alias("period"), F.lit(True).alias("exit"))
    slots = F.when(F.col("executes") & (F.col("period") > 0), F.array(leaving, entry)).otherwise(F.array(entry))
    rows = dated.withColumn("slot", F.explode(slots)).select(
        "symbol", "session", "slot.period", "slot.exit", "i",
        *[dbl(name).alias(name) for name in ("open", "close", "dividend", "split_coefficient")])
    keys = ["symbol", "period"]
    seen = W.partitionBy(*keys).orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    held = with_hold_columns(rows, "", keys).withColumn("entry_open", F.first("open").over(seen)).withColumn(
        "entry_session", F.first("session").over(seen))
    price = F.when(F.col("exit"), F.col("open")).otherwise(F.col("close"))
    return held.select(
        *keys, "session", "exit", "i", "entry_session",
        (F.col("shares") * price / F.col("entry_open")).alias("unit_stock"),
        (F.col("income") / F.col("entry_open")).alias("unit_income"))


def rebalanced_weights(panel: DataFrame, schedule: DataFrame, targets: DataFrame) -> DataFrame:
    """Values of every held position: (strategy, period, session, exit, symbol, weight, stock, part).

    ``part`` is the stock with the dividends it paid since the rebalance, which wait as cash.
    """
    planned = targets.join(
        F.broadcast(schedule.filter("decides").select(
            F.col("session").alias("decision"), F.col("decision_period").alias("period"))), "decision",
    ).select("strategy", "period", "symbol", "weight")
    values = _period_values(panel, schedule)
    return planned.join(values, ["symbol", "period"]).withColumn("stock", F.col("weight") * F.col("unit_stock")).withColumn(
        "part", F.col("stock") + F.col("weight") * F.col("unit_income")).drop("unit_stock", "unit_income")


def rebalanced_curve(
    panel: DataFrame, benchmark: DataFrame, schedule: DataFrame, targets: DataFrame, strategies: Sequence[str],
    cost_bps: float = 0.0, starting_cash: float = 1.0,
) -> DataFrame:
    """Net equity curve per strategy with turnover and cost at each rebalance.

    Costs are charged on the traded share of equity: the net curve is multiplied by
    (1 - cost * turnover) at each execution. A period without targets is held in cash. The valued
    positions feed the closes, the period ends and the turnover, so they are checkpointed once.
    """
    parts = materialize(rebalanced_weights(panel, schedule, targets))
    held = parts.groupBy("strategy", "period", "session", "exit").agg(
        F.sum("part").alias("invested"), F.sum("weight").alias("weight"))
    names = F.explode(F.array(*[F.lit(name) for name in strategies])).alias("strategy")
    days = schedule.select("session", "i", "period", "executes", names)
    closes = days.join(
        held.filter(~F.col("exit")).select("strategy", "session", "period", "invested", "weight"),
        ["strategy", "session", "period"], "left",
    ).withColumn("value", F.when(F.col("i") == 0, F.lit(1.0)).otherwise(
        1 - F.coalesce("weight", F.lit(0.0)) + F.coalesce("invested", F.lit(0.0))))
    exits = held.filter("exit").select(
        "strategy", (F.col("period") + 1).alias("period"), (1 - F.col("weight") + F.col("invested")).alias("carried"))
    turnover = _turnover(parts, exits)
    steps = days.filter("executes AND i >= 1").select("strategy", "period").join(
        exits, ["strategy", "period"], "left").join(turnover, ["strategy", "period"], "left").select(
        "strategy", "period", F.coalesce("carried", F.lit(1.0)).alias("carried"),
        F.coalesce("turnover", F.lit(0.0)).alias("turnover"))
    c = cost_bps / 10_000
    chain = W.partitionBy("strategy").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("strategy").orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    net = 1 - c * F.col("turnover")
    periods = steps.select(
        "strategy", "period", "turnover",
        F.product("carried").over(chain).alias("gross_start"),
        F.coalesce(F.product(net).over(earlier), F.lit(1.0)).alias("net_before"), net.alias("net"))
    curve = closes.join(periods, ["strategy", "period"], "left").select(
        "strategy", "session", "i",
        (starting_cash * F.coalesce(F.col("gross_start") * F.col("net_before") * F.col("net"), F.lit(1.0))
         * F.col("value")).alias("equity"),
        F.when(F.col("executes") & (F.col("i") >= 1), F.coalesce("turnover", F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("turnover"),
        F.when(F.col("executes") & (F.col("i") >= 1),
               starting_cash * F.coalesce(F.col("turnover") * F.col("gross_start") * F.col("net_before") * c, F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("cost"),
    )
    bench = benchmark_curve(benchmark, schedule, starting_cash)
    return curve.join(F.broadcast(bench), "session")


def _turnover(parts: DataFrame, exits: DataFrame) -> DataFrame:
    """Sum of |target - drifted weight| per (strategy, period) without joining the two portfolios."""
    opened = parts.filter(F.col("session") == F.col("entry_session")).filter(~F.col("exit")).select(
        "strategy", "period", "symbol", F.col("weight").alias("change"))
    drifted = parts.filter("exit").select("strategy", (F.col("period") + 1).alias("period"), "symbol", "stock").join(
        exits, ["strategy", "period"]).select(
        "strategy", "period", "symbol", (-F.col("stock") / F.col("carried")).alias("change"))
    return opened.unionByName(drifted).groupBy("strategy", "period", "symbol").agg(
        F.sum("change").alias("change")).groupBy("strategy", "period").agg(F.sum(F.abs("change")).alias("turnover"))


def benchmark_curve(benchmark: DataFrame, schedule: DataFrame, starting_cash: float = 1.0) -> DataFrame:
    """Buy-and-hold value of the benchmark over the scheduled sessions (one row per trading day)."""
    rows = benchmark.join(schedule.select("session"), "session", "left_semi").withColumn("symbol", F.lit("benchmark"))
    return buy_and_hold_value(rows).select("session", (starting_cash * F.col("value")).alias("benchmark_equity"))


def position_weights(panel: DataFrame, schedule: DataFrame, targets: DataFrame) -> DataFrame:
    """Weight of each position in equity at every close."""
    parts = rebalanced_weights(panel, schedule, targets).filter(~F.col("exit"))
    total = W.partitionBy("strategy", "session")
    equity = 1 - F.sum("weight").over(total) + F.sum("part").over(total)
    return parts.select("strategy", "session", "symbol", (F.col("stock") / equity).alias("weight"))


def uncovered_holdings(panel: DataFrame, schedule: DataFrame, targets: DataFrame) -> DataFrame:
    """Held positions that lack a bar on some session of their holding period, with the count."""
    need = schedule.filter("i >= 1").groupBy("period").agg(
        F.count("*").alias("sessions"), F.max("session").alias("until"))
    have = rebalanced_weights(panel, schedule, targets).filter(~F.col("exit")).groupBy(
        "strategy", "period", "symbol").agg(F.count("*").alias("priced"))
    planned = targets.join(schedule.filter("decides").select(
        F.col("session").alias("decision"), F.col("decision_period").alias("period")), "decision")
    return planned.join(F.broadcast(need), "period").join(
        have, ["strategy", "period", "symbol"], "left").select(
        "strategy", "period", "symbol", F.coalesce("priced", F.lit(0)).alias("priced"), "sessions",
    ).filter("priced < sessions")
