"""Orders, fills, positions and cash as tables.

Fill logs have no bound per portfolio or symbol, so everything ordered goes through ``scans``, and
everything else is a partial aggregation. Violations are flagged, not re-routed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark import schemas
from tidemark.functions.columns import canonical, scaled, sha, sorted_list_hash
from tidemark.operators import scans
from tidemark.operators.asof import as_of_join
from tidemark.session import through_table

EPSILON = 1e-9
#: Exact types of running sums: quantities and money to ten places, logarithms to eighteen.
AMOUNT, LOGARITHM = "decimal(28,10)", "decimal(24,18)"


# ------------------------------------------------------------------ execution

def rejection_reason() -> Column:
    """First reason why an order cannot trade on a quote (columns order.*, quote.*), or null."""
    return (
        F.when(F.col("quote.symbol") != F.col("order.symbol"), "quote symbol mismatch")
        .when(F.col("quote.halted"), "instrument halted")
        .when((F.col("quote.observed_at") < F.col("order.earliest_execution_at"))
              | (F.col("quote.available_at") > F.col("quote.observed_at")),
              "quote unavailable for permitted execution session")
        .when(F.col("quote.available_quantity") <= 0, "no executable liquidity"))


def match_quotes(orders: DataFrame, quotes: DataFrame) -> DataFrame:
    """(order, quote): each order with the first quote of its symbol from its execution time on."""
    found = as_of_join(orders, quotes, ["symbol"], "earliest_execution_at", "observed_at", "forward")
    return found.select(F.struct(*orders.columns).alias("order"), F.col("match").alias("quote"))


def execute(pairs: DataFrame, fee: float = 0.0, slippage_bps: float = 2.0) -> DataFrame:
    """Fill quantity, price and costs of each (order, quote) pair, or the reason for rejection."""
    if fee < 0 or slippage_bps < 0:
        raise ValueError(f"fee {fee} and slippage {slippage_bps} bps must be at least 0")
    reason = F.when(F.col("quote").isNull(), F.lit("no quote")).otherwise(rejection_reason())
    direction = F.when(F.col("order.side") == "BUY", 1.0).otherwise(-1.0)
    half, slip = F.col("quote.spread_bps") / 20_000, F.lit(slippage_bps / 10_000)
    quantity = F.least("order.quantity", "quote.available_quantity")
    traded = pairs.withColumn("reason", reason).withColumn("done", F.col("reason").isNull())
    when = lambda value: F.when(F.col("done"), value)
    return traded.select(
        "order.order_id", "order.portfolio", "order.symbol", "order.side",
        when(quantity).alias("quantity"),
        when(F.col("quote.mid") * (1 + direction * (half + slip))).alias("price"),
        when(quantity * F.col("quote.mid") * half).alias("spread_cost"),
        when(quantity * F.col("quote.mid") * slip).alias("slippage_cost"),
        when(F.lit(fee)).alias("fee"), when(F.col("quote.observed_at")).alias("executed_at"),
        F.when(F.col("done"), F.col("order.quantity") - quantity).otherwise(F.col("order.quantity")).alias("residual"),
        F.when(~F.col("done"), "REJECTED").when(quantity < F.col("order.quantity"), "PARTIAL").otherwise("FILLED")
        .alias("status"), "reason")


# ------------------------------------------------------------------ positions

def signed_quantity() -> Column:
    return F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))


def cash_effect() -> Column:
    gross = F.col("quantity") * F.col("price")
    return F.when(F.col("side") == "BUY", -(gross + F.col("fee"))).otherwise(gross - F.col("fee"))


def positions(
    fills: DataFrame, order: Sequence[str], keys: Sequence[str] = ("portfolio", "symbol"),
    fill_id: str | None = "fill_id", max_group_rows: int = scans.MAX_GROUP_ROWS,
) -> DataFrame:
    """Quantity, cost basis and realised result per position at average cost.

    A sell relieves the basis in proportion to the quantity sold, so a buy's share of the final
    basis is the product of what later sells left over; only fills after the last flat point count.
    What the basis does not keep has been relieved, which gives the realised result. A position
    stops at its first sale of more than is held; that fill is named and later ones are left out,
    and ``left_out`` counts them with it. Without ``fill_id``, ``first_short`` tells its place in the order instead of its name.

    Rows move once, before amounts are added to them. Quantities, money and the logarithms of what is left over are summed as decimals: flat and short
    are tested against zero, and the result does not depend on how a group is split.
    """
    keys = list(keys)
    group = scans.ordered(fills, keys, order, max_group_rows)
    rows = group.rows if group.split else group.rows.repartition(*keys)
    group = group.with_rows(rows.withColumn("signed", signed_quantity().cast(AMOUNT)).withColumn("cash", cash_effect().cast(AMOUNT)))
    group = scans.running(group, {"held": ("sum", "signed")})
    short = F.col("held") < 0
    place = F.struct(*order, F.col(fill_id).alias("_fill")) if fill_id else F.struct(*order)
    group = scans.running(group.with_rows(group.rows.withColumn("short", short.cast("int"))), {"broken": ("max", "short")})
    counted = group.rows.withColumn("valid", F.col("broken") == 0)
    before = F.col("held") - F.col("signed")
    sold = F.col("valid") & (F.col("side") == "SELL")
    flat = F.col("valid") & (F.col("held") == 0)
    kept_share = F.col("held").cast("double") / before.cast("double")
    left_over = F.when(sold & ~flat, F.ln(kept_share)).otherwise(F.lit(0.0)).cast(LOGARITHM)
    group = group.with_rows(counted.withColumn("flat", flat.cast("int")).withColumn("left_over", left_over))
    group = scans.running(
        group, {"flats_from_here": ("sum", "flat"), "left_from_here": ("sum", "left_over")}, reverse=True)
    buy = F.col("valid") & (F.col("side") == "BUY")
    kept = F.when(buy & (F.col("flats_from_here") == 0),
                  (-F.col("cash").cast("double") * F.exp(F.col("left_from_here").cast("double"))).cast(AMOUNT))
    total = lambda value: F.coalesce(F.sum(value).cast("double"), F.lit(0.0))
    summed = group.result().groupBy(*keys).agg(
        F.count_if("valid").alias("fills"), F.count_if(~F.col("valid")).alias("left_out"),
        total(F.when(F.col("valid"), F.col("signed"))).alias("quantity"), total(kept).alias("cost_basis"),
        total(F.when(F.col("valid"), F.col("cash"))).alias("cash_flow"),
        F.min(F.when(F.col("short") == 1, place)).alias("first_short"))
    return summed.select(
        *keys, "fills", "quantity", "cost_basis", (F.col("cash_flow") + F.col("cost_basis")).alias("realized_pnl"),
        F.col("first_short._fill").alias("oversold_by") if fill_id else F.col("first_short"), "left_out")


def account_view(held: DataFrame) -> DataFrame:
    """Open positions with their average cost."""
    return held.filter(F.col("quantity") != 0).withColumn("average_cost", F.col("cost_basis") / F.col("quantity"))


def cash_ledger(
    fills: DataFrame, order: Sequence[str], initial_cash: float, fill_id: str = "fill_id",
    max_group_rows: int = scans.MAX_GROUP_ROWS,
) -> DataFrame:
    """Final and lowest cash per portfolio and the first fill that overdraws it."""
    group = scans.ordered(fills.withColumn("cash", cash_effect().cast(AMOUNT)), ["portfolio"], order, max_group_rows)
    rows = scans.running(group, {"flow": ("sum", "cash")}).result().withColumn(
        "balance", F.lit(initial_cash).cast(AMOUNT) + F.col("flow"))
    overdrawn = F.when(F.col("balance") < 0, F.struct(*order, F.col(fill_id).alias("_fill")))
    return rows.groupBy("portfolio").agg(
        (F.lit(initial_cash).cast(AMOUNT) + F.sum("cash")).cast("double").alias("cash"),
        F.min("balance").cast("double").alias("lowest_cash"),
        F.min(overdrawn)["_fill"].alias("overdrawn_by"))


# ------------------------------------------------------------------ valuation

def session_flows(fills: DataFrame) -> DataFrame:
    """(portfolio, symbol, session, delta, flow): quantity and cash that the fills of a session move.

    Bounded by portfolios, symbols and sessions. The functions below take fills or, where several read them, this table."""
    if {"delta", "flow"} <= set(fills.columns):
        return fills
    return fills.groupBy("portfolio", "symbol", "session").agg(F.sum(signed_quantity()).alias("delta"), F.sum(cash_effect()).alias("flow"))


def open_sessions(fills: DataFrame, calendar: DataFrame) -> DataFrame:
    """(portfolio, symbol, session, quantity, trades): a row per session in which a position trades or is open.

    ``calendar`` holds the sessions, one row per trading day, which bounds its broadcast. Fills are summed per session first.
    What is held after a session lasts until the position trades again, and only such spans of open quantity are laid out
    over the calendar: a closed position has no rows until it is opened again.
    """
    keys = ["portfolio", "symbol", "session"]
    flows = session_flows(fills).select(*keys, "delta")
    days = calendar.select("session").distinct()
    numbered = F.broadcast(days.withColumn("day", F.row_number().over(W.orderBy("session"))))
    listed = F.broadcast(days.agg(F.array_sort(F.collect_list("session")).alias("days")))
    by_position = W.partitionBy("portfolio", "symbol").orderBy("session")
    spans = flows.join(numbered, "session").select(
        *keys, "day", F.sum("delta").over(by_position.rowsBetween(W.unboundedPreceding, 0)).alias("quantity"),
        F.lead("day").over(by_position).alias("next_day"))
    lasting = F.when(F.abs("quantity") >= EPSILON, F.coalesce("next_day", F.size("days") + 1) - F.col("day")).otherwise(F.lit(1))
    return spans.crossJoin(listed).select(
        "portfolio", "symbol", "quantity", F.col("session").alias("since"), F.explode(F.slice("days", F.col("day"), lasting)).alias("session"),
    ).select(*keys, "quantity", (F.col("session") == F.col("since")).alias("trades"))


def daily_positions(fills: DataFrame, marks: DataFrame) -> DataFrame:
    """Quantity and mark per (portfolio, symbol, session) in which a position trades, or is open and has a mark.

    ``fills`` has a session column; ``marks`` is (symbol, session, mark), of one row each. A session with a trade but without
    a mark stays, with a null mark. The rows that meet the marks are those of ``open_sessions``.
    """
    calendar = marks.select("session").unionByName(fills.select("session"))
    rows = open_sessions(fills, calendar).join(marks, ["symbol", "session"], "left")
    return rows.filter(F.col("trades") | F.col("mark").isNotNull()).select("portfolio", "symbol", "session", "mark", "quantity")


def cash_by_session(fills: DataFrame, initial_cash: float) -> DataFrame:
    flows = session_flows(fills).groupBy("portfolio", "session").agg(F.sum("flow").alias("flow"))
    seen = W.partitionBy("portfolio").orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    return flows.select("portfolio", "session", "flow", (initial_cash + F.sum("flow").over(seen)).alias("cash"))


def valuations(
    held: DataFrame, cash: DataFrame, benchmark: DataFrame, initial_cash: float, initial_benchmark: float, sessions: DataFrame,
) -> DataFrame:
    """Value, exposure and returns per portfolio and session from its first flow on; missing marks are counted, never guessed.

    ``sessions`` are the days to value, one row per trading day; a portfolio that holds nothing is worth its cash."""
    open_rows = F.abs("quantity") >= EPSILON
    listed = F.broadcast(sessions.agg(F.array_sort(F.collect_set("session")).alias("days")))
    days = cash.groupBy("portfolio").agg(F.min("session").alias("first")).crossJoin(listed).select(
        "portfolio", F.explode(F.filter("days", lambda day: day >= F.col("first"))).alias("session"),
        F.lit(0.0).alias("quantity"), F.lit(None).cast("double").alias("mark"))
    exposure = held.select("portfolio", "session", "quantity", "mark").unionByName(days).groupBy("portfolio", "session").agg(
        F.coalesce(F.sum(F.col("quantity") * F.col("mark")), F.lit(0.0)).alias("gross_exposure"),
        F.count_if(open_rows & F.col("mark").isNull()).alias("missing_marks"))
    seen = W.partitionBy("portfolio").orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    flows = exposure.join(cash.select("portfolio", "session", "cash"), ["portfolio", "session"], "left").withColumn(
        "cash", F.coalesce(F.last("cash", ignorenulls=True).over(seen), F.lit(initial_cash)))
    bench = F.broadcast(benchmark.groupBy("session").agg(F.max("close").alias("benchmark_value")))
    value = F.col("cash") + F.col("gross_exposure")
    return flows.join(bench, "session", "left").select(
        "portfolio", "session", value.alias("portfolio_value"), "benchmark_value", "cash", "gross_exposure",
        (value / initial_cash - 1).alias("total_return"),
        (F.col("benchmark_value") / initial_benchmark - 1).alias("benchmark_return"),
        (value / initial_cash - F.col("benchmark_value") / initial_benchmark).alias("excess_return"), "missing_marks")


def missing_marks(held: DataFrame) -> DataFrame:
    return held.filter((F.abs("quantity") >= EPSILON) & F.col("mark").isNull()).select(
        "portfolio", "symbol", "session", "quantity")


def weight_limit(
    buys: DataFrame, held: DataFrame, cash: DataFrame, initial_cash: float,
) -> DataFrame:
    """Position-weight limit of buys against the portfolio as it stood before the session.

    Positions are valued at each symbol's own mark of the session. ``unmarked`` counts the positions held before it that have
    none; then the portfolio's worth is unknown, and weight and verdict are null.
    """
    per_symbol = W.partitionBy("portfolio", "symbol").orderBy("session")
    opened = held.withColumn("before", F.coalesce(F.lag("quantity").over(per_symbol), F.lit(0.0)))
    is_open = lambda c: F.abs(F.col(c)) >= EPSILON
    worth = opened.groupBy("portfolio", "session").agg(
        F.coalesce(F.sum(F.col("before") * F.col("mark")), F.lit(0.0)).alias("held_value"),
        F.count_if(is_open("before") & F.col("mark").isNotNull()).alias("marked"),
        F.sum(is_open("quantity").cast("bigint") - is_open("before").cast("bigint")).alias("change"))
    # A position without a row in a session has neither mark nor trade there: what is open follows from the changes.
    earlier = W.partitionBy("portfolio").orderBy("session").rowsBetween(W.unboundedPreceding, -1)
    worth = worth.withColumn("unmarked", F.coalesce(F.sum("change").over(earlier), F.lit(0)) - F.col("marked"))
    equity = worth.join(cash, ["portfolio", "session"], "left").withColumn(
        "equity_before", F.when(F.col("unmarked") == 0, F.col("held_value") + F.coalesce(F.col("cash") - F.col("flow"), F.lit(initial_cash))))
    # What a buy is judged by is one small table, so that buys, which have no bound, move once.
    judged = opened.select("portfolio", "symbol", "session", "before", "mark").join(
        equity.select("portfolio", "session", "equity_before", "unmarked"), ["portfolio", "session"])
    rows = buys.filter("side = 'BUY'").join(through_table(judged, "judged-positions"), ["portfolio", "symbol", "session"])
    weight = F.try_divide((F.col("before") + F.col("quantity")) * F.col("mark"), F.col("equity_before"))
    return rows.select(
        "order_id", "portfolio", "symbol", "session", weight.alias("weight"),
        F.when(F.col("unmarked") == 0, F.coalesce(weight <= F.col("max_position_weight"), F.lit(False))).alias("within_limit"), "unmarked")


# ------------------------------------------------------------------ orders from targets

def orders_from_targets(
    targets: DataFrame, held: DataFrame, marks: DataFrame, equity: DataFrame, session_id: str,
    minimum_notional: float = 10.0,
) -> DataFrame:
    """Orders that move each portfolio to its target weights.

    Targets and positions are combined by a full outer join; small trades are skipped. A held symbol
    without a mark gives a MISSING_MARK row instead of an order; a target without a mark is skipped.
    """
    both = targets.select("portfolio", "symbol", "weight").join(
        held.select("portfolio", "symbol", "quantity"), ["portfolio", "symbol"], "full_outer").fillna(
        0.0, ["weight", "quantity"])
    priced = both.join(marks, "symbol", "left").join(equity, "portfolio").filter(
        F.col("mark").isNotNull() | (F.abs("quantity") >= EPSILON))
    delta = F.col("portfolio_value") * F.col("weight") / F.col("mark") - F.col("quantity")
    sized = priced.withColumn("delta", delta).filter(
        F.col("mark").isNull() | (F.abs("delta") * F.col("mark") >= minimum_notional))
    side = F.when(F.col("delta") > 0, "BUY").otherwise("SELL")
    made = F.col("mark").isNotNull()
    return sized.select(
        "portfolio", "symbol",
        F.when(made, F.concat_ws(":", F.lit(session_id), "portfolio", "symbol", side)).alias("order_id"),
        F.when(made, side).alias("side"), F.when(made, F.abs("delta")).alias("quantity"),
        F.col("mark").alias("reference_price"), F.when(made, "ORDER").otherwise("MISSING_MARK").alias("outcome"))


def portfolio_hashes(held: DataFrame, cash: DataFrame, marks: DataFrame) -> DataFrame:
    """SHA-256 per portfolio of its cash, positions and marks (at most one text per listed symbol)."""
    basis = F.col("cost_basis") + F.lit(1e-9)  # decides exact halves, which cents often end on
    line = canonical([F.col("symbol"), scaled("quantity", 6), scaled(basis, 6), scaled("mark", 4)])
    lines = held.join(marks, "symbol", "left").groupBy("portfolio").agg(sorted_list_hash(line).alias("positions"))
    return lines.join(cash.select("portfolio", "cash"), "portfolio").select(
        "portfolio", sha(canonical([scaled("cash", 4), F.col("positions")])).alias("snapshot_hash"))


# ------------------------------------------------------------------ event replay and lifecycle

FROZEN, QUEUED, RESULT = "PAPER_SESSION_FROZEN", "PAPER_ORDER_QUEUED", "PAPER_ORDER_RESULT"
ORDER_PAYLOAD = (
    "struct<order_id:string,portfolio:string,symbol:string,side:string,quantity:double,price:double,fee:double,"
    "submitted_at:string,status:string>"
)


def replay(log: DataFrame, max_group_rows: int = scans.MAX_GROUP_ROWS) -> DataFrame:
    """Outcome of every order event of the log (sequence, event_type, entity_id, payload).

    Orders count if their session was frozen before and they carry its decision time; results count
    if their order was queued before. The first event of an order counts, repeats are flagged. Events
    are parsed and placed against their session once and stored, with the payloads of results, whose fills
    are read from them. Firsts are running minima over one exchange by order, in split scans for an order
    repeated very often.
    """
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    frozen = through_table(log.filter(F.col("event_type") == FROZEN).groupBy("entity_id").agg(
        F.min(F.struct("sequence", field("decision_at").alias("decision_at"))).alias("frozen")), "frozen-sessions")
    events = log.filter(F.col("event_type").isin(QUEUED, RESULT)).select(
        "*", F.json_tuple("payload", "order_id", "submitted_at").alias("order_id", "submitted_at"))
    before = F.coalesce(F.col("frozen.sequence") < F.col("sequence"), F.lit(False))
    state = (
        F.when(F.col("event_type") == RESULT, "RESULT").when(~before, "NOT_FROZEN")
        .when(F.coalesce(F.col("submitted_at") == F.col("frozen.decision_at"), F.lit(False)), "QUEUED")
        .otherwise("WRONG_TIME"))
    placed = through_table(events.join(frozen, "entity_id", "left").select(
        "sequence", "event_type", "order_id", state.alias("state"),
        F.when(F.col("event_type") == RESULT, F.col("payload")).alias("payload")), "replay")
    # Comparisons with a running minimum are strict, so the order of events of one number does not matter.
    group = scans.ordered(placed, ["order_id"], ["sequence"], max_group_rows)
    group = scans.running(group, {"accepted_at": ("min", F.when(F.col("state") == "QUEUED", F.col("sequence")))})
    follows = F.coalesce((F.col("state") == "RESULT") & F.col("order_id").isNotNull() & (F.col("sequence") > F.col("accepted_at")), F.lit(False))
    group = group.with_rows(group.rows.withColumn("follows", follows))
    known = scans.running(group, {"applied_at": ("min", F.when(F.col("follows"), F.col("sequence")))}).result()
    repeated = F.col("order_id").isNotNull() & (F.col("sequence") > F.col("accepted_at"))
    outcome = (
        F.when((F.col("state") == "QUEUED") & repeated, "DUPLICATE")
        .when(F.col("state") != "RESULT", F.col("state")).when(~F.col("follows"), "UNQUEUED")
        .when(F.col("sequence") > F.col("applied_at"), "DUPLICATE").otherwise("APPLIED"))
    return known.select("sequence", "event_type", "order_id", outcome.alias("outcome"), "payload")


def replayed_fills(outcomes: DataFrame) -> DataFrame:
    """Fills of applied results, each order once; only their payloads are parsed."""
    body = outcomes.filter("outcome = 'APPLIED'").select(
        "sequence", "order_id", F.from_json("payload", ORDER_PAYLOAD).alias("body"))
    return body.filter("body.status <> 'REJECTED'").select(
        "sequence", F.col("order_id").alias("fill_id"), "body.portfolio", "body.symbol", "body.side", "body.quantity",
        "body.price", "body.fee")


def transition_audit(
    states: DataFrame, entity: str, order: Sequence[str], max_group_rows: int = scans.MAX_GROUP_ROWS,
) -> DataFrame:
    """Each state change with its predecessor and whether the lifecycle allows it (first states do)."""
    group = scans.ordered(states, [entity], order, max_group_rows)
    rows = scans.running(group, {"previous": ("last", "state")}, exclusive=True).result()
    return with_legality(rows)


def with_legality(rows: DataFrame) -> DataFrame:
    moves = rows.sparkSession.createDataFrame(
        [(a, b, True) for a, b in schemas.LIFECYCLE_MOVES], "previous string, state string, allowed boolean")
    return rows.join(F.broadcast(moves), ["previous", "state"], "left").withColumn(
        "legal", F.col("previous").isNull() | F.coalesce("allowed", F.lit(False))).drop("allowed")


# ------------------------------------------------------------------ operations

def status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per status, with zeros for statuses that do not occur."""
    listed = jobs.sparkSession.createDataFrame([(s,) for s in schemas.JOB_STATUSES], "status string")
    return listed.join(jobs.groupBy("status").agg(F.count("*").alias("jobs")), "status", "left").fillna(0, ["jobs"])


def operational_health(jobs: DataFrame, snapshots: DataFrame, now: Column, maximum_age_days: int = 2) -> DataFrame:
    """Health flag and reasons from dead jobs and the age of the latest snapshot (created_at)."""
    dead = jobs.agg(F.count_if(F.col("status") == "DEAD")).scalar()
    state = snapshots.agg(F.max("created_at").alias("latest")).withColumn("dead", dead)
    reasons = F.array_compact(F.array(
        F.when(F.col("dead") > 0, F.lit("dead-letter jobs require review")),
        F.when(F.col("latest").isNull(), F.lit("no successful data snapshot"))
        .when(now - F.col("latest") > F.make_dt_interval(F.lit(maximum_age_days)), F.lit("latest data snapshot is stale"))))
    return state.withColumn("reasons", reasons).select(
        (F.size("reasons") == 0).alias("healthy"), "dead", "latest", "reasons")
