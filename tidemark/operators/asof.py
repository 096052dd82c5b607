"""As-of joins, membership intervals, calendar lookups and coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark import schemas
from tidemark.operators import scans
from tidemark.session import materialize


MAX_TABLE_ROWS = 1_000_000
MAX_PER_DAY = 64
#: Bytes of right rows that a broadcast day table may hold, measured before it is built.
MAX_TABLE_BYTES = 32 << 20


def as_of_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
    direction: str = "backward", max_group_rows: int = scans.MAX_GROUP_ROWS,
    max_table_rows: int = MAX_TABLE_ROWS,
) -> DataFrame:
    """Every left row with the right row of the same key nearest at or before (after) its time.

    Right columns come back in a nullable struct ``match``. Equal right times: the largest row wins
    going backward, the smallest going forward. Rows with a null key or time match nothing on either
    side; such left rows stay, with a null ``match``. Two ways with the same result, chosen from the
    measured right side:

    * a right side that is sparse per day and small as a (key, day) table, in rows and in bytes,
      becomes such a table and is broadcast, so the left side is not shuffled at all;
    * anything else is merged with the left rows into one ordered scan, which splits hot keys. The
      cost is a sort, never one pair per earlier row.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    forward = direction == "forward"
    payload = F.struct(*[F.col(c) for c in right.columns])
    for name in (*on, right_time):
        right = right.filter(F.col(name).isNotNull())
    facts = right.groupBy(*on, F.col(right_time).alias("_time")).agg(
        (F.min if forward else F.max)(payload).alias("_right"))
    per_day = right.groupBy(*on, F.to_date(right_time).alias("day")).agg(F.count_distinct(right_time).alias("n"))
    size = per_day.groupBy(*on).agg(F.max("n").alias("n"), F.min("day").alias("low"), F.max("day").alias("high")).agg(
        F.count("*").alias("keys"), F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if not size["keys"]:
        return left.withColumn("match", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType))
    days = (size["high"] - size["low"]).days + 3
    joined = None
    if size["keys"] * days <= max_table_rows and size["n"] <= MAX_PER_DAY:
        facts = materialize(facts)
        held = facts.agg(F.sum(F.octet_length(F.to_json("_right")))).first()[0]
        # Next to its own rows, a day holds the nearest row outside it.
        if held + size["keys"] * days * held // max(1, facts.count()) <= MAX_TABLE_BYTES:
            joined = _by_day_table(left, facts, on, left_time, size["low"], size["high"], forward)
    if joined is None:
        joined = _by_scan(left, facts, on, left_time, forward, max_group_rows)
    asked = F.col(left_time).isNotNull()
    for name in on:
        asked = asked & F.col(name).isNotNull()
    return joined.withColumn("match", F.when(asked, F.col("match")))


def _by_day_table(left, facts, on, left_time, low, high, forward) -> DataFrame:
    """Per (key, day): the rows of that day and the nearest row outside it."""
    item = F.struct(F.col("_time"), F.col("_right"))
    daily = facts.groupBy(*on, F.to_date("_time").alias("_day")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    first, last = F.date_sub(F.lit(low), 1), F.date_add(F.lit(high), 1)
    grid = facts.select(*on).distinct().withColumn("_day", F.explode(F.sequence(first, last)))
    filled = grid.join(daily, [*on, "_day"], "left")
    edge = F.element_at("_items", 1 if forward else -1)["_right"]
    order = F.col("_day").desc() if forward else F.col("_day").asc()
    outside = W.partitionBy(*on).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    table = filled.select(*on, "_day", "_items", F.last(edge, ignorenulls=True).over(outside).alias("_outside"))
    asked = left.withColumn("_day", F.least(F.greatest(F.to_date(left_time), first), last))
    joined = asked.join(F.broadcast(table), [*on, "_day"], "left")
    if forward:
        inside = F.filter("_items", lambda x: x["_time"] >= F.col(left_time))
        found = F.get(inside, F.lit(0))
    else:
        inside = F.filter("_items", lambda x: x["_time"] <= F.col(left_time))
        found = F.get(inside, F.size(inside) - 1)
    return joined.select(*left.columns, F.coalesce(found["_right"], F.col("_outside")).alias("match"))


def _by_scan(left, facts, on, left_time, forward, max_group_rows) -> DataFrame:
    """Both sides in one ordered scan per key; equal times match."""
    side = 0 if forward else 1
    queries = left.select(
        *on, F.col(left_time).alias("_time"), F.lit(side).alias("_side"), F.xxhash64(*left.columns).alias("_id"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"), F.lit(None).alias("_right"))
    known = facts.select(
        *on, "_time", F.lit(1 - side).alias("_side"), F.lit(0).cast("bigint").alias("_id"),
        F.lit(None).alias("_left"), "_right")
    group = scans.ordered(queries.unionByName(known), on, ("_time", "_side", "_id"), max_group_rows)
    filled = scans.running(group, {"match": ("last", "_right")}, reverse=forward).result()
    return filled.filter("_left IS NOT NULL").select("_left.*", "match")


def latest_within(
    requests: DataFrame, observations: DataFrame, on: Sequence[str], at: str, available: str, maximum_age: Column,
) -> DataFrame:
    """As-of join with a tolerance: ``match`` is null where the newest observation is too old."""
    joined = as_of_join(requests, observations, on, at, available)
    fresh = F.col(at) - F.col(f"match.{available}") <= maximum_age
    return joined.withColumn("match", F.when(fresh, F.col("match")))


def membership_spans(members: DataFrame) -> DataFrame:
    """(symbol, valid_from, valid_to) from dated member lists; the last span is open."""
    dates = members.select("date").distinct()
    spans = dates.select("date", F.lead("date").over(W.orderBy("date")).alias("valid_to"))
    return members.join(F.broadcast(spans), "date").select(
        "symbol", F.col("date").alias("valid_from"), "valid_to")


def record_dates_on(dates: DataFrame, members: DataFrame) -> DataFrame:
    """Newest membership record at or before each date; both sides hold at most one row per day."""
    marks = members.select("date").distinct().select(
        F.col("date").alias("as_of"), F.col("date").alias("record"), F.lit(0).alias("asked"))
    asked = dates.select(F.col("as_of"), F.lit(None).cast("date").alias("record"), F.lit(1).alias("asked"))
    seen = W.orderBy("as_of", "asked").rowsBetween(W.unboundedPreceding, 0)
    return marks.unionByName(asked).select(
        "as_of", "asked", F.last("record", ignorenulls=True).over(seen).alias("record")).filter(
        "asked = 1").select("as_of", "record")


def members_on(dates: DataFrame, members: DataFrame) -> DataFrame:
    """Members as of each date; a date before the first record keeps one row without a symbol."""
    found = record_dates_on(dates, members)
    return found.join(members.withColumnRenamed("date", "record"), "record", "left").select(
        "as_of", "record", "symbol")


def top_by_market_cap(
    decisions: DataFrame, members: DataFrame, caps: DataFrame, count: int = 100, maximum_age_days: int = 10,
) -> DataFrame:
    """Largest members at each decision by their newest fresh market cap; ``complete`` tells if enough.

    ``decisions`` has (as_of date, decided_at timestamp).
    """
    eligible = members_on(decisions.select("as_of"), members).filter("symbol IS NOT NULL").join(
        F.broadcast(decisions), "as_of").select("as_of", "decided_at", "symbol")
    found = latest_within(
        eligible, caps.select("symbol", "available_to_strategy_at", "market_cap"), ["symbol"], "decided_at",
        "available_to_strategy_at", F.make_dt_interval(F.lit(maximum_age_days)),
    ).filter("match IS NOT NULL").select("as_of", "symbol", "match.market_cap")
    per_decision = W.partitionBy("as_of")
    ranked = found.select(
        "*", F.row_number().over(per_decision.orderBy(F.desc("market_cap"), "symbol")).alias("rank"),
        F.count("*").over(per_decision).alias("fresh"))
    return ranked.filter(F.col("rank") <= count).withColumn("complete", F.col("fresh") >= count)


def latest_facts(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Newest filed value per (symbol, decision, concept): largest (filed, end) not after the decision."""
    value = F.struct("filed", F.coalesce("end", F.lit("")).alias("end"), "val", "form")
    filings = facts.select(
        "symbol", "concept", F.col("filed").alias("day"), F.lit(0).alias("asked"), value.alias("fact"))
    asked = decisions.select(
        "symbol", F.explode(F.array(*[F.lit(c) for c in schemas.CONCEPTS])).alias("concept"),
        F.col("decision_on").alias("day"), F.lit(1).alias("asked"), F.lit(None).alias("fact"))
    seen = W.partitionBy("symbol", "concept").orderBy("day", "asked").rowsBetween(W.unboundedPreceding, 0)
    return filings.unionByName(asked).withColumn("latest", F.max("fact").over(seen)).filter(
        "asked = 1 AND latest IS NOT NULL").select(
        "symbol", F.col("day").alias("decision_on"), "concept", "latest.filed", "latest.end", "latest.val",
        "latest.form")


def filing_evidence(facts: DataFrame, decisions: DataFrame, retrieved_at: Column) -> DataFrame:
    """One evidence row per (symbol, decision) from the newest filings; none where nothing was filed."""
    place = F.array_position(F.array(*[F.lit(c) for c in schemas.CONCEPTS]), F.col("concept"))
    text = F.format_string("%s=%s (%s, period ended %s)", "concept", "val", "form", "end")
    rows = latest_facts(facts, decisions).groupBy("symbol", "decision_on").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(place.alias("place"), text.alias("text")))),
            lambda item: item["text"]), "; ").alias("claim"),
        F.max("filed").alias("filed"))
    available = F.col("filed").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(12))
    return rows.select(
        F.concat_ws(":", F.lit("sec"), "symbol", F.col("decision_on").cast("string")).alias("id"),
        "symbol", "claim", F.lit("SEC EDGAR company facts").alias("source"),
        *[available.alias(n) for n in ("observed_at", "published_at", "available_to_strategy_at")],
        retrieved_at.alias("retrieved_at"),
        F.concat(F.lit("retrieved:"), F.date_format(retrieved_at, "yyyy-MM-dd'T'HH:mm:ss")).alias("vintage"),
        F.lit("PASS").alias("quality"), "decision_on")


def calendar_spans(calendar: DataFrame) -> DataFrame:
    """Each session with the next one, and the half-open time during which it is the latest closed."""
    order = W.orderBy("session")
    return calendar.select(
        "session", "close_at", F.lead("close_at").over(order).alias("next_close_at"),
        F.lead("session").over(order).alias("next_session"), F.lead("open_at").over(order).alias("next_open_at"))


def latest_closed(times: DataFrame, at: str, calendar: DataFrame) -> DataFrame:
    """Latest closed session and the session after it for any number of times.

    Spans are spelled out per day, so the lookup is a hash join on the day with at most a few
    candidates; times outside the calendar get nulls. The day table is bounded by the calendar.
    """
    spans = calendar_spans(calendar).filter("next_close_at IS NOT NULL")
    days = F.sequence(F.to_date("close_at"), F.to_date("next_close_at"))
    daily = spans.withColumn("day", F.explode(days))
    asked = times.withColumn("day", F.to_date(at))
    inside = (asked.day == daily.day) & (F.col(at) >= F.col("close_at")) & (F.col(at) < F.col("next_close_at"))
    return asked.join(F.broadcast(daily), inside, "left").select(
        *times.columns, F.col("session").alias("latest_session"), "next_session", "next_open_at")


def member_sessions(sessions: DataFrame, members: DataFrame) -> DataFrame:
    """(session, symbol) pairs that must have a bar."""
    return members_on(sessions.select(F.col("session").alias("as_of")), members).filter(
        "symbol IS NOT NULL").select(F.col("as_of").alias("session"), "symbol")


def window_completeness(symbols: DataFrame, sessions: DataFrame, bars: DataFrame) -> DataFrame:
    """Sessions present and missing per listed symbol; a symbol without any bar in the window misses all."""
    held = bars.join(F.broadcast(sessions), "session", "left_semi").groupBy("symbol").agg(
        F.count_distinct("session").alias("present"))
    total = sessions.agg(F.count_distinct("session")).scalar()
    return symbols.join(held, "symbol", "left").select("symbol", F.coalesce("present", F.lit(0)).cast("bigint").alias("present")).withColumn(
        "missing", total - F.col("present")).withColumn("complete", F.col("missing") == 0)


def missing_prices(sessions: DataFrame, members: DataFrame, bars: DataFrame) -> DataFrame:
    return member_sessions(sessions, members).join(bars.select("session", "symbol"), ["session", "symbol"], "left_anti")


def coverage_audit(sessions: DataFrame, members: DataFrame, bars: DataFrame) -> DataFrame:
    """Eligible and covered member sessions, the coverage ratio, and whether nothing is missing."""
    held = bars.select("session", "symbol").distinct().withColumn("covered", F.lit(1))
    joined = member_sessions(sessions, members).join(held, ["session", "symbol"], "left")
    return joined.agg(
        F.count("*").alias("eligible"), F.count("covered").alias("covered"),
    ).select(
        "eligible", "covered", F.try_divide(F.col("covered"), F.col("eligible")).alias("coverage"),
        (F.col("eligible") == F.col("covered")).alias("approved"))


def snapshot_completeness(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """Whether every symbol of a request has its bar of the session by the decision time.

    The newest eligible bar is the session's own exactly when that bar exists and was available, so
    an equi-join decides it. ``requests``: (request_id, session, decision_at, run_at, symbols array).
    """
    known = bars.select("symbol", "session", "available_to_strategy_at")
    wanted = requests.select("*", F.explode_outer("symbols").alias("symbol"))
    joined = wanted.join(known, ["symbol", "session"], "left")
    present = F.col("available_to_strategy_at").isNotNull() & (
        F.col("available_to_strategy_at") <= F.col("decision_at"))
    checked = joined.groupBy("request_id", "session", "decision_at", "run_at").agg(
        F.count("symbol").alias("symbols"),
        F.array_sort(F.collect_set(F.when(F.col("symbol").isNotNull() & ~present, F.col("symbol")))).alias("missing"))
    status = (
        F.when(F.col("symbols") == 0, "EMPTY_UNIVERSE").when(F.col("run_at") < F.col("decision_at"), "BEFORE_CUTOFF")
        .when(F.size("missing") > 0, "INCOMPLETE").otherwise("COMPLETE"))
    return checked.withColumn("status", status)


def history_edges(symbols: DataFrame, bars: DataFrame, start: str, end: str, maximum_gap_days: int = 10) -> DataFrame:
    """Reason a symbol's history is unusable over a window, null where it covers both edges."""
    low, high = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    edges = bars.filter(F.col("session").between(low, high)).groupBy("symbol").agg(
        F.min("session").alias("first_session"), F.max("session").alias("last_session"))
    gap = (F.col("first_session") > F.date_add(low, maximum_gap_days)) | (
        F.col("last_session") < F.date_sub(high, maximum_gap_days))
    reason = F.when(F.col("first_session").isNull(), F.lit("not downloaded")).when(
        gap, F.format_string("incomplete coverage %s..%s", F.col("first_session").cast("string"),
                             F.col("last_session").cast("string")))
    return symbols.join(edges, "symbol", "left").withColumn("reason", reason)
