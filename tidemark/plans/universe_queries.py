"""Registered queries: point-in-time membership, as-of joins and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import joined, normal_text, r
from tidemark.operators import asof, curves, strategies
from tidemark.plans import driver_tables as d
from tidemark.plans.curves_queries import COST, EVERY, LOOKBACKS, TOP, curve_columns, panel
from tidemark.plans.universe import point_in_time_curve
from tidemark.session import materialize
from tidemark.sources import membership, payloads

START, END = "1997-02-10", "1998-11-16"


def members(bars):
    return membership.expand_members(d.membership_records(bars))


def membership_history(spark, sf):
    return members(d.bars(spark, sf))


def membership_spans(spark, sf):
    return asof.membership_spans(members(d.bars(spark, sf)))


def members_on(spark, sf):
    bars, bench = panel(spark, sf)
    dates = bench.select(F.col("session").alias("as_of"))
    return asof.members_on(dates, members(bars)).select("as_of", "record", "symbol")


def month_decisions(bars):
    firsts = bars.select(F.trunc("session", "month").alias("as_of")).distinct()
    return firsts.withColumn("decided_at", F.col("as_of").cast("timestamp_ntz") + F.make_dt_interval(F.lit(3), F.lit(9)))


def fresh_market_caps(spark, sf):
    bars, _ = panel(spark, sf)
    asked = bars.select(
        "symbol", "session", (F.col("session").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(12))).alias("at"))
    found = asof.latest_within(
        asked, d.stored_market_caps(spark, sf), ["symbol"], "at", "available_to_strategy_at", F.make_dt_interval(F.lit(10)))
    return found.select(
        "symbol", "session", F.col("match.observed_date").alias("observed_date"),
        r("match.market_cap", 2).alias("market_cap"))


def top_market_cap(spark, sf):
    bars, _ = panel(spark, sf)
    return asof.top_by_market_cap(month_decisions(bars), members(bars), d.stored_market_caps(spark, sf), 10).select(
        "as_of", "symbol", r("market_cap", 2).alias("market_cap"), F.col("rank").cast("bigint").alias("rank"), "complete")


def filings(bars):
    """Quarterly totals as filed facts; some are annual, some of another form, some amended later."""
    quarter = bars.groupBy("symbol", F.last_day(F.add_months(F.trunc("session", "quarter"), 2)).alias("end_on")).agg(
        F.sum("volume").alias("volume"))
    kinds = F.explode(F.array(*[
        F.struct(F.lit(name).alias("concept"), F.lit(n).alias("n"))
        for n, name in enumerate(("Revenues", "NetIncomeLoss", "Assets", "Liabilities", "Goodwill"))]))
    rows = quarter.withColumn("kind", kinds).select(
        "symbol", "kind.concept", F.lit("USD").alias("unit"),
        F.date_add("end_on", 20 + 5 * F.col("kind.n")).alias("filed"), F.col("end_on").cast("string").alias("end"),
        (F.col("volume") * (F.col("kind.n") + 1)).cast("string").alias("val"),
        F.when(F.month("end_on") == 12, "10-K").when(F.col("volume") % 10 == 0, "8-K").otherwise("10-Q").alias("form"))
    amended = rows.filter("CAST(val AS BIGINT) % 7 = 0").withColumn("unit", F.lit("EUR")).withColumn(
        "filed", F.date_add("filed", 40)).withColumn("val", F.concat("val", F.lit("1")))
    return rows.unionByName(amended)


def company_payloads(bars):
    filing = F.struct("val", "form", F.col("filed").cast("string").alias("filed"), "end")
    units = filings(bars).groupBy("symbol", "concept", "unit").agg(F.collect_list(filing).alias("filings"))
    facts = units.groupBy("symbol", "concept").agg(
        F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "filings"))).alias("units")).alias("fact"))
    per_symbol = facts.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("concept", "fact"))).alias("us-gaap"))
    return per_symbol.select("symbol", F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("payload"))


def company_facts(spark, sf):
    return payloads.parse_company_facts(company_payloads(d.bars(spark, sf)))


def filing_decisions(bars):
    return bars.select("symbol").distinct().withColumn("decision_on", F.explode(F.sequence(
        F.lit("1995-03-01").cast("date"), F.lit("2000-12-01").cast("date"), F.expr("interval 2 months"))))


def filing_evidence(spark, sf):
    bars = d.stored_bars(spark, sf)
    facts = payloads.parse_company_facts(company_payloads(bars))
    retrieved = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    return asof.filing_evidence(facts, filing_decisions(bars), retrieved).select(
        "id", "symbol", "claim", "available_to_strategy_at", "vintage")


def latest_session(spark, sf):
    times = d.read(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(22))).alias("at"))
    return asof.latest_closed(times, "at", d.calendar(d.bars(spark, sf))).select(
        "o_orderkey", "latest_session", "next_session", "next_open_at")


def coverage_audit(spark, sf):
    bars, bench = panel(spark, sf)
    return asof.coverage_audit(bench.select("session"), members(bars), bars).select(
        "eligible", "covered", r("coverage").alias("coverage"), "approved")


def missing_prices(spark, sf):
    bars, bench = panel(spark, sf)
    return asof.missing_prices(bench.select("session"), members(bars), bars)


def snapshot_completeness(spark, sf):
    bars = d.stored_bars(spark, sf)
    symbols = F.array_sort(F.collect_set("symbol"))
    sessions = d.calendar(bars)
    listed = bars.groupBy().agg(symbols.alias("symbols"))
    requests = sessions.select(
        F.concat(F.lit("u:"), F.col("session").cast("string")).alias("request_id"), "session",
        F.col("close_at").alias("decision_at"),
        F.when(F.day("session") == 13, F.col("open_at")).otherwise(F.col("close_at")).alias("run_at"),
        F.when(F.day("session") == 20, F.array().cast("array<string>")).otherwise(listed.scalar()).alias("symbols"))
    return asof.snapshot_completeness(requests, bars).select(
        "request_id", "symbols", "status", joined("missing").alias("missing"))


def history_edges(spark, sf):
    bars, _ = panel(spark, sf)
    thin = bars.filter("NOT (symbol = 'Brand-9' AND session > date'1998-06-01') AND symbol <> 'Brand-11'")
    return asof.history_edges(bars.select("symbol").distinct(), thin, START, END).select(
        "symbol", "first_session", "last_session", "reason")


def dynamic_membership_curve(spark, sf):
    bars, bench = panel(spark, sf)
    listed = materialize(members(bars))
    first = listed.agg(F.min("date")).scalar()
    full = curves.common_sessions(bars, bench).filter(F.col("session") >= first)
    return curve_columns(point_in_time_curve(
        bars, bench.join(F.broadcast(full), "session", "left_semi"), listed, LOOKBACKS, TOP, EVERY, COST))


def required_symbols(spark, sf):
    bars, _ = panel(spark, sf)
    rows = members(bars)
    return strategies.required_symbols(asof.membership_spans(rows), rows, START, END)


def cached_symbols(bars):
    return bars.filter("volume % 90 = 0").select("symbol")


def download_worklist(spark, sf):
    bars, _ = panel(spark, sf)
    rows = members(bars)
    needed = strategies.required_symbols(asof.membership_spans(rows), rows, START, END)
    return strategies.download_worklist(needed, cached_symbols(bars))


def worklist_counts(spark, sf):
    bars, _ = panel(spark, sf)
    rows = members(bars)
    needed = strategies.required_symbols(asof.membership_spans(rows), rows, START, END)
    return strategies.worklist_counts(needed, cached_symbols(bars))


def topic_sets(spark, sf):
    """Set equality, subset test and order-keeping de-duplication over the turns of a conversation."""
    topic = F.concat("role", F.lit("-"), (F.col("turn") % 3).cast("string"))
    # Only first mentions are gathered: as many as a conversation has different topics, however long it is.
    first = d.read(spark, sf, "conversations").select("conv_id", "turn", topic.alias("topic")).groupBy(
        "conv_id", normal_text("topic").alias("name")).agg(F.min(F.struct("turn", "topic")).alias("at"))
    turns = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("turns"))
    topics = F.transform("turns", lambda t: t["name"])
    wanted = F.array(*[F.lit(x) for x in ("user-0", "assistant-1")])
    return turns.withColumn("topics", topics).select(
        "conv_id", joined(F.array_distinct("topics")).alias("first_mentions"),
        (F.array_sort(F.array_distinct("topics")) == F.array_sort(wanted)).alias("equals"),
        (F.size(F.array_except("topics", wanted)) == 0).alias("subset"))


QUERIES = {
    "membership_history": membership_history,
    "membership_spans": membership_spans,
    "members_on_date": members_on,
    "fresh_market_caps": fresh_market_caps,
    "top_market_cap": top_market_cap,
    "company_facts": company_facts,
    "filing_evidence": filing_evidence,
    "latest_closed_session": latest_session,
    "coverage_audit": coverage_audit,
    "missing_prices": missing_prices,
    "snapshot_completeness": snapshot_completeness,
    "history_edges": history_edges,
    "dynamic_membership_curve": dynamic_membership_curve,
    "required_symbols": required_symbols,
    "download_worklist": download_worklist,
    "worklist_counts": worklist_counts,
    "set_comparisons": topic_sets,
}
