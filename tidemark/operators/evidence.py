"""Evidence curation and the audit of cited research reports, over many cases at once.

All results are long tables keyed by case; sets are counted with distributed distinct aggregates, so
no case, topic or claim is ever gathered into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import check_rows, normal_text, sha

# Routes and blocker codes of the audit.
INSUFFICIENT = "ABSTAIN_INSUFFICIENT_EVIDENCE"
BLOCKED = "ABSTAIN_AUDIT_BLOCKED"
SYNTHESIS_FAILED = "ABSTAIN_SYNTHESIS_FAILED"
SYNTHESIS_INVALID = "ABSTAIN_SYNTHESIS_INVALID"
COMPLETE = "SYNTHESIS_COMPLETE"


def fresh(maximum_age_days: int) -> Column:
    """Point-in-time and freshness rule of one record at one decision."""
    available, decision = F.col("available_to_strategy_at"), F.col("decision_at")
    return (
        (F.col("quality") == "PASS") & (F.col("published_at") <= available) & (available <= decision)
        & (F.col("observed_at") <= decision)
        & (decision - available <= F.make_dt_interval(F.lit(maximum_age_days))))


def _near_days(cases: DataFrame, evidence: DataFrame, maximum_age_days: int) -> tuple[DataFrame, DataFrame, str]:
    """Both sides with a bucket of days: a record that is fresh for a case shares one of the case's two buckets, so an
    equality join meets neither older nor later records of a much-covered key."""
    width = max(1, maximum_age_days + 1)
    day = lambda name: F.floor(F.unix_date(F.to_date(name)) / width)
    last = day("decision_at")
    return (cases.withColumn("_bucket", F.explode(F.array(last - 1, last))),
            evidence.withColumn("_bucket", day("available_to_strategy_at")), "_bucket")


def check_evidence(
    cases: DataFrame, evidence: DataFrame, maximum_age_days: int, on: Sequence[str] = ("symbol",),
) -> DataFrame:
    """One check per (case, record); a case without records gets one failed ``evidence_present``."""
    records = evidence.select(
        *on, "id", "quality", "published_at", "available_to_strategy_at", "observed_at")
    joined = cases.join(records, [*on], "left")
    return joined.select(
        "case_id",
        F.when(F.col("id").isNull(), F.lit("evidence_present")).otherwise(F.concat(F.lit("evidence:"), "id")).alias("check"),
        F.coalesce(fresh(maximum_age_days), F.lit(False)).alias("passed"))


def all_pass(checks: DataFrame, cases: DataFrame) -> DataFrame:
    """True only where a case has checks and every one passes."""
    found = checks.groupBy("case_id").agg(F.bool_and("passed").alias("passed"))
    return cases.select("case_id").join(found, "case_id", "left").select(
        "case_id", F.coalesce("passed", F.lit(False)).alias("passed"))


def all_fresh(cases: DataFrame, evidence: DataFrame, maximum_age_days: int, on: Sequence[str] = ("symbol",)) -> DataFrame:
    """(case_id, passed): whether a case has records and all are fresh, as ``all_pass`` over ``check_evidence`` says.

    All records of a key pass at a decision if all are sound by themselves, the newest is not from after it and the oldest
    not too old; so each key becomes one row with these times before it meets its cases, and no case meets a record."""
    sound = (F.col("quality") == "PASS") & (F.col("published_at") <= F.col("available_to_strategy_at")) & F.col("observed_at").isNotNull()
    keyed = evidence.groupBy(*on).agg(
        F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound"), F.min("available_to_strategy_at").alias("oldest"),
        F.greatest(F.max("available_to_strategy_at"), F.max("observed_at")).alias("newest"))
    decision = F.col("decision_at")
    passed = F.col("sound") & (F.col("newest") <= decision) & (decision - F.col("oldest") <= F.make_dt_interval(F.lit(maximum_age_days)))
    return cases.select("case_id", "decision_at", *on).join(keyed, [*on], "left").groupBy("case_id").agg(
        F.bool_and(F.coalesce(passed, F.lit(False))).alias("passed"))


def curate(
    cases: DataFrame, evidence: DataFrame, maximum_age_days: int, on: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Usable records per case without repeats: (case_id, id, source, available_to_strategy_at).

    Copies share source, normalised claim, times and vintage; the smallest id stays. Claims enter the
    shuffle as a hash of their whole text, and copies are combined on the map side.
    """
    asked, records, bucket = _near_days(cases.select("case_id", "decision_at", *on), evidence, maximum_age_days)
    usable = records.withColumn("claim_hash", sha(normal_text("claim"))).drop("claim").join(asked, [*on, bucket]).filter(
        fresh(maximum_age_days) & (F.col("retrieved_at") >= F.col("published_at")))
    return usable.groupBy(
        "case_id", "source", "claim_hash", "published_at",
        "available_to_strategy_at", "vintage",
    ).agg(F.min("id").alias("id")).select("case_id", "id", "source", "available_to_strategy_at")


def sufficiency(cases: DataFrame, curated: DataFrame, minimum_records: int = 2) -> DataFrame:
    counts = curated.groupBy("case_id").agg(
        F.count("*").alias("records"), F.count_distinct("source").alias("sources"))
    return cases.join(counts, "case_id", "left").fillna(0, ["records", "sources"]).withColumn(
        "sufficient", F.col("records") >= minimum_records)


def flat_findings(nested: DataFrame) -> DataFrame:
    """Nested reports (findings array) as one row per finding, the form the audit works on."""
    return nested.select("case_id", "report_id", F.explode("findings").alias("finding")).select(
        "case_id", "report_id", "finding.*")


def citations(findings: DataFrame) -> DataFrame:
    return findings.select("case_id", F.explode("evidence_ids").alias("id")).distinct()


def unknown_citations(findings: DataFrame, curated: DataFrame) -> DataFrame:
    return citations(findings).join(curated.select("case_id", "id"), ["case_id", "id"], "left_anti")


def contradictions(findings: DataFrame) -> DataFrame:
    """Topics with support and concern; HIGH if any finding on the topic is, neutral ones included."""
    found = findings.groupBy("case_id", normal_text("topic").alias("topic")).agg(
        F.count_distinct(F.when(F.col("stance") == "SUPPORT", F.col("report_id"))).alias("supporting"),
        F.count_distinct(F.when(F.col("stance") == "CONCERN", F.col("report_id"))).alias("concerning"),
        F.bool_or(F.col("severity") == "HIGH").alias("high"))
    return found.filter("supporting > 0 AND concerning > 0").select(
        "case_id", "topic", "supporting", "concerning",
        F.when(F.col("high"), "HIGH").otherwise("MEDIUM").alias("severity"), F.lit(False).alias("resolved"))


def contradiction_reports(findings: DataFrame) -> DataFrame:
    """Who stands on which side of each contradiction, one row per report."""
    sides = findings.filter("stance IN ('SUPPORT', 'CONCERN')").select(
        "case_id", normal_text("topic").alias("topic"), "stance", "report_id").distinct()
    return sides.join(contradictions(findings).select("case_id", "topic"), ["case_id", "topic"], "left_semi")


def audit_measures(
    cases: DataFrame, curated: DataFrame, reports: DataFrame, findings: DataFrame, minimum_sources: int = 2,
    minimum_coverage: float = 0.75,
) -> DataFrame:
    """Per case: the six audit checks as columns and the citation coverage.

    Cases without reports pass the identity and citation checks, as there is nothing to refute.
    """
    base = sufficiency(cases, curated)
    heads = reports.join(
        cases.select("case_id", F.col("symbol").alias("case_symbol"), "decision_at"), "case_id")
    identity = heads.groupBy("case_id").agg(
        F.count_distinct(F.when(F.col("role").isin(*schemas.ROLES), F.col("role"))).alias("roles"),
        F.bool_and((F.col("symbol") == F.col("case_symbol")) & (F.col("as_of") == F.col("decision_at"))).alias("identity"))
    known = curated.select("case_id", "id").withColumn("known", F.lit(True))
    cited = citations(findings).join(known, ["case_id", "id"], "left").groupBy("case_id").agg(
        F.count("known").alias("cited"), F.count_if(F.col("known").isNull()).alias("strangers"))
    clashes = contradictions(findings).groupBy("case_id").agg(
        F.count_if((F.col("severity") == "HIGH") & ~F.col("resolved")).alias("high"))
    joined = base.join(identity, "case_id", "left").join(cited, "case_id", "left").join(clashes, "case_id", "left")
    zero = joined.fillna(0, ["roles", "cited", "strangers", "high"]).withColumn(
        "coverage", F.coalesce(F.try_divide(F.col("cited"), F.col("records")), F.lit(0.0)))
    return zero.select(
        "case_id", "symbol", "decision_at", "records", "sufficient", "coverage",
        (F.col("roles") == len(schemas.ROLES)).alias("all_roles_present"),
        F.coalesce("identity", F.lit(True)).alias("report_identity"),
        (F.col("strangers") == 0).alias("evidence_references"),
        (F.col("sources") >= minimum_sources).alias("source_diversity"),
        (F.col("coverage") >= minimum_coverage).alias("evidence_coverage"),
        (F.col("high") == 0).alias("high_severity_contradictions"))


CHECKS = (
    "all_roles_present", "report_identity", "evidence_references", "source_diversity", "evidence_coverage",
    "high_severity_contradictions",
)


def audit_checks(measures: DataFrame) -> DataFrame:
    """Six checks per case with enough evidence; otherwise the one failed completeness check."""
    full = check_rows({name: F.col(name) for name in CHECKS})
    short = check_rows({"evidence_completeness": F.lit(False)})
    rows = measures.withColumn("gate", F.explode(F.when(F.col("sufficient"), full).otherwise(short)))
    return rows.select("case_id", "gate.check", "gate.passed")


def _passes() -> Column:
    ok = F.col(CHECKS[0])
    for name in CHECKS[1:]:
        ok = ok & F.col(name)
    return ok


def blocker_codes(measures: DataFrame, reports: DataFrame, failures: DataFrame) -> DataFrame:
    """Distinct (case_id, code): runner failures, report blockers, and codes derived from the checks."""
    full = measures.filter("sufficient")
    stated = failures.select("case_id", "code").unionByName(
        reports.select("case_id", F.explode("blockers").alias("code"))).join(
        full.select("case_id"), "case_id", "left_semi")
    derived = F.array_compact(F.array(
        F.when(~F.col("high_severity_contradictions"), F.lit("UNRESOLVED_HIGH_CONTRADICTION")),
        F.when(~_passes(), F.lit("AUDIT_CHECK_FAILED"))))
    own = full.select("case_id", F.explode(derived).alias("code"))
    short = measures.filter("NOT sufficient").select("case_id", F.lit("INSUFFICIENT_EVIDENCE").alias("code"))
    return stated.unionByName(own).unionByName(short).distinct()


def audit(measures: DataFrame, codes: DataFrame) -> DataFrame:
    """Approved cases: enough evidence, every check passed, no blocker."""
    blocked = codes.groupBy("case_id").agg(F.count("*").alias("blockers"))
    return measures.join(blocked, "case_id", "left").fillna(0, ["blockers"]).withColumn(
        "approved", F.col("sufficient") & _passes() & (F.col("blockers") == 0)).withColumn(
        "coverage", F.when(F.col("sufficient"), F.col("coverage")).otherwise(F.lit(0.0)))


def valid_syntheses(
    cases: DataFrame, syntheses: DataFrame, reports: DataFrame, curated: DataFrame,
) -> DataFrame:
    """Per synthesis: does it name its case, exactly the case's reports, and only curated evidence."""
    expected = reports.select("case_id", "report_id").distinct().withColumn("expected", F.lit(True))
    named = syntheses.select("case_id", F.explode("report_ids").alias("report_id")).distinct().withColumn(
        "named", F.lit(True))
    sets = expected.join(named, ["case_id", "report_id"], "full_outer").groupBy("case_id").agg(
        F.bool_and(F.col("expected").isNotNull() & F.col("named").isNotNull()).alias("reports_equal"))
    strangers = syntheses.select("case_id", F.explode("evidence_ids").alias("id")).distinct().join(
        curated.select("case_id", "id"), ["case_id", "id"], "left_anti").groupBy("case_id").agg(
        F.count("*").alias("strangers"))
    own = cases.select("case_id", F.col("symbol").alias("case_symbol"), "decision_at")
    return syntheses.join(own, "case_id").join(sets, "case_id", "left").join(strangers, "case_id", "left").select(
        "case_id", "verdict",
        ((F.col("symbol") == F.col("case_symbol")) & (F.col("as_of") == F.col("decision_at"))
         & F.coalesce("reports_equal", F.lit(False)) & F.col("strangers").isNull()).alias("valid"))


def routes(audited: DataFrame, synthesised: DataFrame) -> DataFrame:
    """Final route and verdict of each case; a missing synthesis means the step failed."""
    joined = audited.join(synthesised, "case_id", "left")
    route = (
        F.when(~F.col("sufficient"), INSUFFICIENT).when(~F.col("approved"), BLOCKED)
        .when(F.col("valid").isNull(), SYNTHESIS_FAILED).when(~F.col("valid"), SYNTHESIS_INVALID).otherwise(COMPLETE))
    return joined.withColumn("route", route).select(
        "case_id", "symbol", "decision_at", "route",
        F.when(F.col("route") == COMPLETE, F.col("verdict")).alias("verdict"))


def approvals(routed: DataFrame) -> DataFrame:
    """Approval table for gated selections: only a completed supporting verdict approves."""
    return routed.select(
        "case_id", "symbol", "decision_at", F.coalesce(F.col("verdict") == "SUPPORT", F.lit(False)).alias("approved"))


def outcome_counts(routed: DataFrame) -> DataFrame:
    """Counts by route and verdict with subtotals (nulls mark totals)."""
    rows = routed.withColumn("verdict", F.coalesce("verdict", F.lit("NONE")))
    return rows.rollup("route", "verdict").agg(F.count("*").alias("cases"))
