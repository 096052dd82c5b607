"""Registered queries: evidence checks, report audit, routes, and ranking-based selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import joined, r
from tidemark.operators import evidence as ev
from tidemark.operators import features, quality, strategies
from tidemark.plans import compare, curves_queries
from tidemark.plans import driver_tables as d
from tidemark.plans.curves_queries import COST, EVERY, LOOKBACKS, fixed_panel, rounded_metrics
from tidemark.plans.prices_queries import panel
from tidemark.session import materialize
from tidemark.sources import stores

AGE = 120
TOP = 6


def symbol_cases(spark, sf):
    """One decision per listed brand."""
    rows = d.read(spark, sf, "part").select(F.replace("p_brand", F.lit("#"), F.lit("-")).alias("symbol")).distinct()
    return rows.select(
        F.regexp_extract("symbol", r"(\d+)$", 1).cast("bigint").alias("case_id"), "symbol",
        F.lit("2001-07-15 00:00:00").cast("timestamp_ntz").alias("decision_at"))


def evidence_checks(spark, sf):
    # All records of one brand are filed under a name that no case asks for.
    records = d.evidence(spark, sf).withColumn("symbol", F.when(F.col("symbol") == "Brand-7", "Unlisted").otherwise(F.col("symbol")))
    return ev.check_evidence(symbol_cases(spark, sf), records, AGE)


def evidence_all_pass(spark, sf):
    cases = symbol_cases(spark, sf)
    # Even brands have fresh records only, and every fourth brand none of bad quality.
    number, fresh = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int"), F.lit("2001-05-01").cast("timestamp_ntz")
    times = ("observed_at", "published_at", "available_to_strategy_at")
    records = d.evidence(spark, sf).withColumns(
        {name: F.when(number % 2 == 0, fresh).otherwise(F.col(name)) for name in times}
        | {"quality": F.when(number % 4 == 0, "PASS").otherwise(F.col("quality"))})
    return ev.all_fresh(cases, records, AGE)


def curated_evidence(spark, sf):
    return ev.curate(symbol_cases(spark, sf), d.evidence(spark, sf), AGE)


class Council:
    """Inputs of the case audit. Some cases cite unknown records or miss their synthesis."""

    def __init__(self, spark, sf):
        self.cases = d.cases(spark, sf)
        self.evidence = d.case_evidence(spark, sf)
        self.reports = d.reports(spark, sf)
        # Every other case has no severe finding and cites known records only.
        calm = F.col("case_id") % 2 == 0
        self.findings = d.findings(spark, sf).withColumns({
            "severity": F.when(calm & (F.col("severity") == "HIGH"), "LOW").otherwise(F.col("severity")),
            "evidence_ids": F.when(calm, F.array(F.concat(F.lit("e"), (F.col("turn") % 4).cast("string")))).otherwise(F.col("evidence_ids"))})
        self.curated = ev.curate(self.cases, self.evidence, AGE, ("case_id", "symbol"))
        self.failures = self.cases.filter("case_id % 13 = 12").select(
            "case_id", F.lit("FAILURE_MODE:TimeoutError").alias("code"))

    def measures(self):
        return ev.audit_measures(self.cases, self.curated, self.reports, self.findings)

    def audited(self):
        measures = materialize(self.measures())
        return ev.audit(measures, ev.blocker_codes(measures, self.reports, self.failures))

    def syntheses(self):
        listed = self.reports.groupBy("case_id").agg(F.array_sort(F.collect_set("report_id")).alias("report_ids"))
        case = F.col("case_id")
        return listed.join(self.cases, "case_id").filter("case_id % 8 <> 7").select(
            "case_id", "symbol", F.col("decision_at").alias("as_of"),
            F.when(case % 3 == 0, "SUPPORT").when(case % 3 == 1, "CONCERN").otherwise("ABSTAIN").alias("verdict"),
            F.lit("summary").alias("summary"),
            F.when(case % 5 == 4, F.slice("report_ids", 2, 10)).otherwise(F.col("report_ids")).alias("report_ids"),
            F.when(case % 6 == 5, F.array(F.lit("e0"), F.lit("e9"))).otherwise(F.array(F.lit("e0"), F.lit("e1")))
            .alias("evidence_ids"))

    def routed(self):
        return ev.routes(self.audited(), ev.valid_syntheses(self.cases, self.syntheses(), self.reports, self.curated))


def sufficiency(spark, sf):
    c = Council(spark, sf)
    return ev.sufficiency(c.cases, c.curated).select("case_id", "symbol", "records", "sources", "sufficient")


def audit_checks(spark, sf):
    return ev.audit_checks(Council(spark, sf).measures())


def blocker_codes(spark, sf):
    c = Council(spark, sf)
    return ev.blocker_codes(materialize(c.measures()), c.reports, c.failures)


def audits(spark, sf):
    return Council(spark, sf).audited().select("case_id", "records", r("coverage").alias("coverage"), "blockers", "approved")


def contradictions(spark, sf):
    return ev.contradictions(d.findings(spark, sf))


def contradiction_reports(spark, sf):
    return ev.contradiction_reports(d.findings(spark, sf))


def unknown_citations(spark, sf):
    c = Council(spark, sf)
    return ev.unknown_citations(c.findings, c.curated)


def synthesis_validation(spark, sf):
    c = Council(spark, sf)
    return ev.valid_syntheses(c.cases, c.syntheses(), c.reports, c.curated)


def case_routes(spark, sf):
    return Council(spark, sf).routed()


def approvals(spark, sf):
    return ev.approvals(Council(spark, sf).routed())


def outcome_counts(spark, sf):
    return ev.outcome_counts(Council(spark, sf).routed())


def audited_results(spark, sf):
    """Audits with their content hash against a store that holds some of them, one altered."""
    rows = audits(spark, sf).withColumn("coverage", (F.col("coverage") * 1_000_000).cast("bigint"))
    hashed = stores.hashed_results(rows, ["case_id"])
    stored = hashed.filter("case_id % 3 = 0").withColumn("payload_hash", F.when(
        F.col("case_id") % 9 == 0, F.lit("altered")).otherwise(F.col("payload_hash")))
    return stores.result_conflicts(stored, hashed, "case_id").select("case_id", "payload_hash", "outcome")


def stored_result_check(spark, sf):
    rows = audits(spark, sf).withColumn("coverage", (F.col("coverage") * 1_000_000).cast("bigint"))
    stored = stores.hashed_results(rows, ["case_id"]).withColumn("blockers", F.when(
        F.col("case_id") % 4 == 1, F.col("blockers") + 1).otherwise(F.col("blockers")))
    return stores.verify_results(stored, ["case_id"]).select("case_id")


def finding_validity(spark, sf):
    rows = d.findings(spark, sf)
    rows = rows.select("report_id", F.struct(*rows.columns).alias("finding"))
    return rows.select("report_id", "finding.turn", joined(quality.finding_violations()).alias("violations")).filter(
        "violations <> ''")


def report_validity(spark, sf):
    return d.reports(spark, sf).select("report_id", joined(quality.report_violations()).alias("violations")).filter(
        "violations <> ''")


def synthesis_validity(spark, sf):
    rows = Council(spark, sf).syntheses().select(
        "case_id", F.when(F.col("case_id") % 4 == 3, F.lit("")).otherwise(F.col("summary")).alias("summary"),
        F.when(F.col("case_id") % 5 == 3, F.lit("MAYBE")).otherwise(F.col("verdict")).alias("verdict"),
        F.filter("report_ids", lambda x: x % 4 != F.col("case_id") % 4).alias("report_ids"),
        F.when(F.col("case_id") % 6 == 2, F.array().cast("array<string>")).otherwise(F.col("evidence_ids"))
        .alias("evidence_ids"))
    return rows.select("case_id", joined(quality.synthesis_violations()).alias("violations")).filter("violations <> ''")


# ------------------------------------------------------------------ rankings

def packets(spark, sf):
    rows, _, schedule = fixed_panel(spark, sf)
    decisions = schedule.filter("decides").select(F.col("session").alias("decision"))
    return materialize(features.ranker_packets(rows, decisions, (21, 63, 126), 62))


def composite(spark, sf):
    ranked = strategies.composite_ranking(packets(spark, sf), ("decision",))
    return ranked.select("decision", "id", "symbol", r("score").alias("score"), F.col("position").cast("bigint").alias("position"))


def responses(packet):
    """Outside rankings: a hash order of some ids, with one unknown and one repeated id each."""
    token = F.md5(F.concat_ws(":", F.col("decision").cast("string"), "id"))
    listed = packet.withColumn("token", token).filter("token < 'a'").groupBy("decision").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("token", "id"))), lambda x: x["id"]).alias("ids"))
    return listed.select("decision", F.concat(
        F.slice("ids", 1, 4), F.array(F.lit("asset_999")), F.slice("ids", 2, 1), F.slice("ids", F.lit(5), F.size("ids"))).alias("ranked_ids"))


def ranking_rows(packet, size=20):
    ranked = strategies.composite_ranking(packet, ("decision",)).select("decision", "id", "position")
    return strategies.normalize_rankings(responses(packet), ranked, size)


def normalized_rankings(spark, sf):
    return ranking_rows(packets(spark, sf)).select("decision", "id", F.col("position").cast("bigint").alias("position"), "source")


def ranking_portfolio(spark, sf):
    packet = packets(spark, sf)
    aliases = packet.select("decision", "id", "symbol").filter("month(decision) <> 8 OR symbol < 'Brand-12'")
    return strategies.ranking_targets(ranking_rows(packet), aliases, TOP).select(
        "decision", "symbol", F.col("position").cast("bigint").alias("position"), r("weight").alias("weight"))


def ranked_strategy_sweep(spark, sf):
    """Outside rankings and the reviewed selection traded like any strategy: next-open curve, costs, stages and metrics."""
    bars, bench = panel(spark, sf)
    packet = packets(spark, sf)
    columns = ["strategy", "decision", "symbol", "weight"]
    listed = strategies.ranking_targets(ranking_rows(packet), packet.select("decision", "id", "symbol"), TOP).withColumn(
        "strategy", F.lit("ranked_list"))
    reviewed = gated_targets(packet).withColumn("strategy", F.lit("reviewed_list"))
    rows = compare.universe_sweep(
        bars, bench, LOOKBACKS, curves_queries.TOP, EVERY, warmup=40, cost_bps=COST,
        extra_targets=listed.select(*columns).unionByName(reviewed.select(*columns)), extra_names=("ranked_list", "reviewed_list"))
    return rounded_metrics(rows, ["strategy", "stage"])


def unknown_ranking_ids(spark, sf):
    packet = packets(spark, sf)
    ids = responses(packet).select("decision", F.explode("ranked_ids").alias("id"))
    return strategies.unknown_ids(ids, packet).select("decision", "id")


def gated_targets(packet):
    ranked = strategies.composite_ranking(packet, ("decision",)).select("decision", "symbol", "position")
    brand = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    reviews = packet.filter(brand % 4 > 0).select(
        "decision", "symbol", ((brand * 7 + F.month("decision")) % 3 > 0).alias("approved"))
    return strategies.gated_targets(ranked, reviews, 15, TOP)


def gated_selection(spark, sf):
    return gated_targets(packets(spark, sf)).select(
        "decision", "symbol", F.col("place").cast("bigint").alias("place"), r("weight").alias("weight"))


QUERIES = {
    "evidence_checks": evidence_checks,
    "evidence_all_pass": evidence_all_pass,
    "curated_evidence": curated_evidence,
    "evidence_sufficiency": sufficiency,
    "audit_checks": audit_checks,
    "blocker_codes": blocker_codes,
    "case_audits": audits,
    "contradictions": contradictions,
    "contradiction_reports": contradiction_reports,
    "unknown_citations": unknown_citations,
    "synthesis_validation": synthesis_validation,
    "case_routes": case_routes,
    "case_approvals": approvals,
    "outcome_counts": outcome_counts,
    "audited_results": audited_results,
    "stored_result_check": stored_result_check,
    "finding_validity": finding_validity,
    "report_validity": report_validity,
    "synthesis_validity": synthesis_validity,
    "composite_ranking": composite,
    "normalized_rankings": normalized_rankings,
    "ranking_portfolio": ranking_portfolio,
    "ranked_strategy_sweep": ranked_strategy_sweep,
    "unknown_ranking_ids": unknown_ranking_ids,
    "gated_selection": gated_selection,
}
