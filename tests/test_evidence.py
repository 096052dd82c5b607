"""Evidence curation, report audit, routes and ranking selections."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from tidemark.operators import evidence as ev
from tidemark.operators import strategies
from tidemark.schemas import ROLES

AT = datetime(2025, 6, 1)
EVIDENCE = ("case_id int, symbol string, id string, claim string, source string, observed_at timestamp_ntz, published_at timestamp_ntz, "
            "available_to_strategy_at timestamp_ntz, retrieved_at timestamp_ntz, vintage string, quality string")


def record(case, id_, claim="claim", source="s1", age=1, quality="PASS", retrieved=None):
    at = AT - timedelta(days=age)
    return (case, "A", id_, claim, source, at, at, at, retrieved or at, "v", quality)


def cases(spark, *ids):
    return spark.createDataFrame([(i, "A", AT) for i in ids], "case_id int, symbol string, decision_at timestamp_ntz")


def test_curation_keeps_usable_records_once(spark):
    rows = [record(1, "keep"), record(1, "zcopy", " \tCLAIM \n"), record(1, "old", "x", age=200), record(1, "stale", "y", quality="STALE"),
            record(1, "future", "z", age=-1), record(1, "early", "w", retrieved=AT - timedelta(days=9)), record(1, "other", "claim", source="s2")]
    frame = spark.createDataFrame(rows, EVIDENCE)
    assert {r["id"] for r in ev.curate(cases(spark, 1), frame, 120, ("case_id", "symbol")).collect()} == {"keep", "other"}
    checks = {r["check"]: r["passed"] for r in ev.check_evidence(cases(spark, 1, 2), frame, 120, ("case_id", "symbol")).collect()}
    assert checks["evidence:early"] and not checks["evidence:future"] and checks["evidence_present"] is False
    passed = ev.all_pass(ev.check_evidence(cases(spark, 1, 2), frame.filter("id = 'keep'"), 120, ("case_id", "symbol")), cases(spark, 1, 2))
    assert {r["case_id"]: r["passed"] for r in passed.collect()} == {1: True, 2: False}


REPORT = "case_id int, report_id string, role string, symbol string, as_of timestamp_ntz, blockers array<string>"
FINDING = "case_id int, report_id string, topic string, stance string, severity string, evidence_ids array<string>"


class Desk:
    """Case 1 is sound; each other case breaks one rule."""

    def __init__(self, spark):
        self.cases = cases(spark, *range(1, 9))
        rows = []
        for c in range(1, 9):
            rows += [record(c, "e1", "a"), record(c, "e2", "b", source="s1" if c == 3 else "s2")]
        rows = [r for r in rows if not (r[0] == 8 and r[2] == "e2")]
        self.curated = ev.curate(self.cases, spark.createDataFrame(rows, EVIDENCE), 120, ("case_id", "symbol"))
        reports, findings = [], []
        for c in range(1, 9):
            for k, role in enumerate(ROLES if c != 2 else ROLES[:3]):
                reports.append((c, f"{c}-{k}", role, "B" if (c, k) == (4, 0) else "A", AT, ["HOLD"] if (c, k) == (7, 1) else []))
                cited = ["e1", "e2"] if c != 5 else ["e1", "e9"]
                stance = "CONCERN" if c == 6 and k == 1 else "SUPPORT"
                findings.append((c, f"{c}-{k}", " Leverage\t" if k else "leverage", stance, "HIGH" if k == 2 else "LOW", cited))
        self.reports = spark.createDataFrame(reports, REPORT)
        self.findings = spark.createDataFrame(findings, FINDING)
        self.none = spark.createDataFrame([], "case_id int, code string")
        self.measures = ev.audit_measures(self.cases, self.curated, self.reports, self.findings)

    def audited(self):
        return ev.audit(self.measures, ev.blocker_codes(self.measures, self.reports, self.none))


def test_each_broken_rule_blocks_its_case(spark):
    desk = Desk(spark)
    failed = {}
    for r in ev.audit_checks(desk.measures).filter("NOT passed").collect():
        failed.setdefault(r["case_id"], set()).add(r["check"])
    assert failed == {
        2: {"all_roles_present"}, 3: {"source_diversity"}, 4: {"report_identity"},
        5: {"evidence_references", "evidence_coverage"}, 6: {"high_severity_contradictions"}, 8: {"evidence_completeness"}}
    assert {r["case_id"]: r["approved"] for r in desk.audited().collect()} == {1: True, **{c: False for c in range(2, 9)}}
    codes = {}
    for r in ev.blocker_codes(desk.measures, desk.reports, desk.none).collect():
        codes.setdefault(r["case_id"], set()).add(r["code"])
    assert codes[7] == {"HOLD"} and codes[8] == {"INSUFFICIENT_EVIDENCE"}
    assert codes[6] == {"UNRESOLVED_HIGH_CONTRADICTION", "AUDIT_CHECK_FAILED"}
    clash = ev.contradictions(desk.findings).collect()
    assert [(r["case_id"], r["topic"], r["supporting"], r["concerning"], r["severity"]) for r in clash] == [(6, "leverage", 3, 1, "HIGH")]
    sides = ev.contradiction_reports(desk.findings).filter("stance = 'CONCERN'").collect()
    assert [r["report_id"] for r in sides] == ["6-1"]


def test_no_reports_means_nothing_to_refute(spark):
    empty = spark.createDataFrame([], REPORT), spark.createDataFrame([], FINDING)
    frame = spark.createDataFrame([record(1, "e1", "a"), record(1, "e2", "b", "s2")], EVIDENCE)
    row = ev.audit_measures(cases(spark, 1), ev.curate(cases(spark, 1), frame, 120, ("case_id", "symbol")), *empty).first()
    assert row["report_identity"] and row["evidence_references"] and not row["all_roles_present"] and row["coverage"] == 0


def test_routes_and_approvals(spark):
    desk = Desk(spark)
    audited = desk.audited().filter("case_id IN (1, 2, 8)")
    schema = "case_id int, symbol string, as_of timestamp_ntz, verdict string, report_ids array<string>, evidence_ids array<string>"
    names = [f"1-{k}" for k in range(4)]

    def route(*rows):
        found = ev.valid_syntheses(desk.cases, spark.createDataFrame(list(rows), schema), desk.reports, desk.curated)
        return {r["case_id"]: r for r in ev.routes(audited, found).collect()}

    good = route((1, "A", AT, "SUPPORT", names, ["e1"]))
    assert {c: r["route"] for c, r in good.items()} == {1: ev.COMPLETE, 2: ev.BLOCKED, 8: ev.INSUFFICIENT}
    assert good[1]["verdict"] == "SUPPORT"
    assert route((1, "A", AT, "SUPPORT", names[1:], ["e1"]))[1]["route"] == ev.SYNTHESIS_INVALID
    assert route((1, "A", AT, "SUPPORT", names, ["e7"]))[1]["route"] == ev.SYNTHESIS_INVALID
    assert route()[1]["route"] == ev.SYNTHESIS_FAILED
    routed = ev.routes(audited, ev.valid_syntheses(
        desk.cases, spark.createDataFrame([(1, "A", AT, "SUPPORT", names, ["e1"])], schema), desk.reports, desk.curated))
    assert {r["case_id"]: r["approved"] for r in ev.approvals(routed).collect()} == {1: True, 2: False, 8: False}
    totals = {(r["route"], r["verdict"]): r["cases"] for r in ev.outcome_counts(routed).collect()}
    assert totals[(None, None)] == 3 and totals[(ev.COMPLETE, "SUPPORT")] == 1


def test_outside_rankings_are_made_whole(spark):
    d = date(2025, 1, 1)
    ranked = spark.createDataFrame([(d, f"a{k}", k) for k in range(1, 6)], "decision date, id string, position int")
    answer = spark.createDataFrame([(d, ["a3", "zz", "a3", "a1"])], "decision date, ranked_ids array<string>")
    rows = strategies.normalize_rankings(answer, ranked, 4).orderBy("position").collect()
    assert [(r["id"], r["source"]) for r in rows] == [("a3", "ranker"), ("a1", "ranker"), ("a2", "fallback"), ("a4", "fallback")]
    long = spark.createDataFrame([(d, ["a3", "a1", "a2", "a5", "a4"])], "decision date, ranked_ids array<string>")
    assert strategies.normalize_rankings(long, ranked, 2).count() == 5
    aliases = spark.createDataFrame([(d, f"a{k}", f"S{k}") for k in range(1, 6)], "decision date, id string, symbol string")
    made = strategies.normalize_rankings(answer, ranked, 4)
    assert {r["symbol"]: r["weight"] for r in strategies.ranking_targets(made, aliases, 2).collect()} == {"S3": 0.5, "S1": 0.5}
    assert strategies.ranking_targets(made, aliases, 6).count() == 0


def test_gate_needs_a_positive_review(spark):
    d = date(2025, 1, 1)
    ranked = spark.createDataFrame([(d, f"S{k}", k) for k in range(1, 6)], "decision date, symbol string, position int")
    reviews = spark.createDataFrame([(d, "S1", False), (d, "S2", True), (d, "S4", True), (d, "S5", True)], "decision date, symbol string, approved boolean")
    found = strategies.gated_targets(ranked, reviews, shortlist=4, top_n=3).collect()
    assert {r["symbol"]: r["weight"] for r in found} == {"S2": 0.5, "S4": 0.5}


def test_all_fresh_equals_the_checks(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        age = rng.choice([1, 5, 50, 119, 121, -1]) if k % 3 == 0 else rng.choice([1, 60])
        rows.append(record(k % 20, f"r{k}", f"claim {k}", age=age, quality=rng.choice(["PASS"] * 9 + ["STALE", None])))
    frame = spark.createDataFrame(rows, EVIDENCE)
    asked = cases(spark, *range(22))
    whole = ev.all_pass(ev.check_evidence(asked, frame, 120, ("case_id", "symbol")), asked)
    found = ev.all_fresh(asked, frame, 120, ("case_id", "symbol"))
    right = {r["case_id"]: r["passed"] for r in whole.collect()}
    assert {r["case_id"]: r["passed"] for r in found.collect()} == right and len(set(right.values())) == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("min(available_to_strategy_at")
