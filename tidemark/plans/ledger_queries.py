"""Registered queries: order checks, execution, positions, valuation, replay and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import joined, r, settled
from tidemark.operators import ledger, quality
from tidemark.plans import driver_tables as d
from tidemark.session import through_table

CASH, BENCH = 300_000.0, 50.0
DAY = "1998-06-29"


def with_session(rows, column="executed_on"):
    return rows.withColumn("session", F.trunc(column, "week"))


def marks(bars):
    """Opening marks; a few are missing."""
    return bars.filter("volume % 50 <> 0").select("symbol", "session", F.col("open").alias("mark"))


def order_validity(spark, sf):
    n = F.length("order_id") + F.col("quantity").cast("int")
    rows = d.orders(spark, sf).withColumns({
        "quantity": F.when(n % 31 == 0, -F.col("quantity")).otherwise(F.col("quantity")),
        "max_position_weight": F.when(n % 17 == 0, F.lit(1.5)).otherwise(F.col("max_position_weight")),
        "earliest_execution_at": F.when(n % 13 == 0, F.col("submitted_at")).otherwise(F.col("earliest_execution_at")),
        "side": F.when(n % 29 == 0, F.lit("HOLD")).otherwise(F.col("side")),
    })
    return rows.select("order_id", joined(quality.order_violations()).alias("violations")).filter("violations <> ''")


def quote_validity(spark, sf):
    rows = d.quotes(d.bars(spark, sf)).withColumns({
        "mid": F.when(F.col("available_quantity") % 41 == 0, F.lit(0.0)).otherwise(F.col("mid")),
        "spread_bps": F.when(F.col("available_quantity") % 37 == 0, F.lit(-1.0)).otherwise(F.col("spread_bps")),
        "available_quantity": F.when(F.col("available_quantity") % 43 == 0, F.lit(-5.0)).otherwise(F.col("available_quantity")),
    })
    return rows.select("symbol", "session", joined(quality.quote_violations()).alias("violations")).filter("violations <> ''")


def executed(spark, sf):
    return ledger.execute(
        ledger.match_quotes(d.orders(spark, sf).drop("decision_id"), d.quotes(d.stored_bars(spark, sf))), 1.0, 5.0)


def fill_validity(spark, sf):
    rows = executed(spark, sf).filter("status <> 'REJECTED'").withColumns({
        "fee": F.when(F.col("quantity") == 13, F.lit(-1.0)).otherwise(F.col("fee")),
        "price": F.when(F.col("quantity") == 17, F.lit(0.0)).otherwise(F.col("price"))})
    return rows.select("order_id", joined(quality.fill_violations()).alias("violations")).filter("violations <> ''")


def executability(spark, sf):
    """Given pairs: orders against the quote of the following week, some of another symbol."""
    orders = with_session(d.orders(spark, sf), "submitted_at").select(
        F.struct("symbol", "order_id", "earliest_execution_at").alias("order"),
        F.date_add("session", F.when(F.col("quantity") % 5 == 0, 0).otherwise(7)).alias("quoted_on"),
        F.when(F.col("quantity") % 11 == 0, F.lit("Brand-1")).otherwise(F.col("symbol")).alias("asked"))
    q = d.quotes(d.bars(spark, sf)).withColumn("available_quantity", F.when(
        F.col("available_quantity") % 7 == 0, 0.0).otherwise(F.col("available_quantity")))
    quotes = q.select(F.col("symbol").alias("asked"), F.col("session").alias("quoted_on"), F.struct(*q.columns).alias("quote"))
    return orders.join(quotes, ["asked", "quoted_on"]).select(
        F.col("order.order_id").alias("order_id"), F.coalesce(ledger.rejection_reason(), F.lit("executable")).alias("reason"))


def order_quotes(spark, sf):
    pairs = ledger.match_quotes(d.orders(spark, sf), d.quotes(d.stored_bars(spark, sf)))
    return pairs.select(
        F.col("order.order_id").alias("order_id"), F.col("quote.session").alias("session"),
        F.col("quote.mid").alias("mid"), F.coalesce("quote.halted", F.lit(False)).alias("halted"))


def executions(spark, sf):
    numbers = ("quantity", "price", "spread_cost", "slippage_cost", "fee", "residual")
    return executed(spark, sf).select(
        "order_id", "side", *[r(c).alias(c) for c in numbers], "executed_at", "status", "reason")


def held(spark, sf):
    return ledger.positions(d.fills(spark, sf), d.FILL_ORDER)


def position_columns(rows):
    return rows.select(
        "portfolio", "symbol", "fills", r("quantity").alias("quantity"), settled("cost_basis").alias("cost_basis"),
        settled("realized_pnl").alias("realized_pnl"), "oversold_by")


def positions(spark, sf):
    return position_columns(held(spark, sf))


def account_view(spark, sf):
    return ledger.account_view(held(spark, sf)).select(
        "portfolio", "symbol", r("quantity").alias("quantity"), settled("average_cost").alias("average_cost"))


def cash_ledger(spark, sf):
    return ledger.cash_ledger(d.fills(spark, sf), d.FILL_ORDER, CASH).select(
        "portfolio", r("cash", 4).alias("cash"), r("lowest_cash", 4).alias("lowest_cash"), "overdrawn_by")


def book(spark, sf):
    """Bars, flows per session, positions and cash; fills are read and joined once, for the flows."""
    bars = d.stored_bars(spark, sf)
    flows = through_table(ledger.session_flows(with_session(d.fills(spark, sf))), "session-flows")
    return bars, flows, ledger.daily_positions(flows, marks(bars)), ledger.cash_by_session(flows, CASH)


def valued(spark, sf):
    bars, _, positions_, cash = book(spark, sf)
    return ledger.valuations(positions_, cash, d.benchmark_bars(bars), CASH, BENCH, marks(bars).select("session"))


def valuations(spark, sf):
    return valued(spark, sf).select(
        "portfolio", "session", *[r(c, 4).alias(c) for c in ("portfolio_value", "benchmark_value", "cash", "gross_exposure")],
        *[r(c, 9).alias(c) for c in ("total_return", "benchmark_return", "excess_return")], "missing_marks")


def missing_marks(spark, sf):
    _, _, positions_, _ = book(spark, sf)
    return ledger.missing_marks(positions_).select("portfolio", "symbol", "session", r("quantity").alias("quantity"))


def weight_limits(spark, sf):
    bars, _, positions_, cash = book(spark, sf)
    buys = with_session(d.orders(spark, sf), "submitted_at").withColumn("max_position_weight", F.lit(0.02))
    return ledger.weight_limit(buys, positions_, cash, CASH).select(
        "order_id", "session", r("weight").alias("weight"), "unmarked",
        F.coalesce(F.col("within_limit").cast("string"), F.lit("unknown")).alias("within_limit"))


def target_orders(spark, sf):
    bars, flows, positions_, cash = book(spark, sf)
    day = F.to_date(F.lit(DAY))
    equity = ledger.valuations(positions_, cash, d.benchmark_bars(bars), CASH, BENCH, marks(bars).select("session")).filter(
        F.col("session") == day).select("portfolio", "portfolio_value")
    # Positions ever held may be targets again, closed ones too, if they trade or have a mark on the day.
    ever = flows.filter(F.col("session") <= day).groupBy("portfolio", "symbol").agg(
        F.sum("delta").alias("quantity"), F.max("session").alias("last"))
    marked = marks(bars).filter(F.col("session") == day).select("symbol", F.lit(True).alias("marked"))
    now = ever.join(marked, "symbol", "left").filter(F.col("marked") | (F.col("last") == day)).select("portfolio", "symbol", "quantity")
    p, b = F.regexp_extract("portfolio", r"(\d+)$", 1).cast("int"), F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    targets = now.filter((p + b) % 3 == 0).select("portfolio", "symbol", F.lit(0.08).alias("weight"))
    today = bars.filter((F.col("session") == day) & (F.col("symbol") != "Brand-9")).select("symbol", F.col("open").alias("mark"))
    return ledger.orders_from_targets(targets, now, today, equity, DAY).select(
        "portfolio", "symbol", "order_id", "side", r("quantity").alias("quantity"), "reference_price", "outcome")


def portfolio_hashes(spark, sf):
    last = d.bars(spark, sf).groupBy("symbol").agg(F.max_by("close", "session").alias("mark"))
    cash = ledger.cash_ledger(d.fills(spark, sf), d.FILL_ORDER, CASH)
    return ledger.portfolio_hashes(held(spark, sf), cash, last)


# ------------------------------------------------------------------ replay

def replay_log(spark, sf):
    """Session, order and result events of every fill, with late, repeated and unknown ones planted.

    Stored once, as an event log is: fills are read and joined once and each gives its events; sessions come from them.
    """
    fills = d.fills(spark, sf)
    key, day = F.col("l_orderkey"), F.unix_date("executed_on").cast("bigint") * 1000
    stamp = F.when(key % 37 == 0, F.date_add("executed_on", 1)).otherwise(F.col("executed_on")).cast("string")
    body = F.to_json(F.struct(
        F.col("fill_id").alias("order_id"), "portfolio", "symbol", "side", "quantity", "price", "fee",
        stamp.alias("submitted_at"), F.when(key % 29 == 0, "REJECTED").otherwise("FILLED").alias("status")))

    def event(kind, offset):
        return F.struct((day + offset).alias("sequence"), F.lit(kind).alias("event_type"))

    events = F.array_compact(F.array(
        event(ledger.QUEUED, 100), F.when(key % 41 == 0, event(ledger.QUEUED, 150)),
        event(ledger.RESULT, 200), F.when(key % 43 == 0, event(ledger.RESULT, 250))))
    entity = F.concat_ws(":", "portfolio", F.col("executed_on").cast("string")).alias("entity_id")
    of_orders = through_table(
        fills.select("portfolio", "executed_on", entity, body.alias("payload"), F.explode(events).alias("event")).select(
            "portfolio", "executed_on", "event.sequence", "event.event_type", "entity_id", "payload"), "event-log")
    frozen = of_orders.filter("portfolio <> 'P9'").select("portfolio", "executed_on").distinct().select(
        (F.unix_date("executed_on").cast("bigint") * 1000 + F.when(F.col("portfolio") == "P7", 120).otherwise(0)).alias("sequence"),
        F.lit(ledger.FROZEN).alias("event_type"), entity,
        F.to_json(F.struct(F.col("executed_on").cast("string").alias("decision_at"))).alias("payload"))
    return frozen.unionByName(of_orders.select(*frozen.columns))


def event_replay(spark, sf):
    return ledger.replay(replay_log(spark, sf)).select("sequence", "event_type", "order_id", "outcome")


def replayed_positions(spark, sf):
    fills = through_table(ledger.replayed_fills(ledger.replay(replay_log(spark, sf))), "replayed-fills")
    return position_columns(ledger.positions(fills, ("sequence", "fill_id")))


def transition_audit(spark, sf):
    return ledger.transition_audit(d.lifecycle(spark, sf), "user_id", ("ts", "event_id")).select(
        "user_id", "event_id", "previous", "state", "legal")


def status_counts(spark, sf):
    return ledger.status_counts(d.jobs(spark, sf))


def operational_health(spark, sf):
    snapshots = d.jobs(spark, sf).filter("status = 'SUCCEEDED' AND job_id % 100 < 50").select(
        F.col("updated_at").alias("created_at"))
    now = F.lit("2024-02-02 00:00:00").cast("timestamp_ntz")
    return ledger.operational_health(d.jobs(spark, sf), snapshots, now).select(
        "healthy", "dead", "latest", joined("reasons").alias("reasons"))


QUERIES = {
    "order_validity": order_validity,
    "quote_validity": quote_validity,
    "fill_validity": fill_validity,
    "executability_reasons": executability,
    "order_quote_match": order_quotes,
    "executions": executions,
    "positions": positions,
    "account_view": account_view,
    "cash_ledger": cash_ledger,
    "valuations": valuations,
    "missing_marks": missing_marks,
    "weight_limits": weight_limits,
    "target_orders": target_orders,
    "portfolio_hashes": portfolio_hashes,
    "event_replay": event_replay,
    "replayed_positions": replayed_positions,
    "transition_audit": transition_audit,
    "job_status_counts": status_counts,
    "operational_health": operational_health,
}
