"""Oracle SQL: evidence checks, report audit, routes, and ranking-based selections."""

from __future__ import annotations

from oracle.curves import HITS, METRICS, W, sweep
from oracle.fixtures import cte, r, with_
from oracle.prices import broken

UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
N = "CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS INTEGER)"
CUT = "TIMESTAMP '2001-07-15 00:00:00'"
FRESH = f"""(quality = 'PASS' AND available_to_strategy_at <= {CUT} AND {CUT} - available_to_strategy_at <= INTERVAL '120' DAY)"""
NORMAL = r"lower(regexp_replace(claim, '^\s+|\s+$', '', 'g'))"

cte("symbols", "SELECT DISTINCT replace(p_brand, '#', '-') AS symbol FROM part")
cte("trimmed_findings", """
SELECT * REPLACE (CASE WHEN case_id % 2 = 0 AND severity = 'HIGH' THEN 'LOW' ELSE severity END AS severity,
                  CASE WHEN case_id % 2 = 0 THEN 'e' || (turn % 4) ELSE citation END AS citation) FROM findings""", "findings")


def contradictions(source: str) -> str:
    return f"""
SELECT case_id, topic, count(DISTINCT CASE WHEN stance = 'SUPPORT' THEN report_id END) AS supporting,
       count(DISTINCT CASE WHEN stance = 'CONCERN' THEN report_id END) AS concerning,
       CASE WHEN bool_or(severity = 'HIGH') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, false AS resolved
FROM {source} GROUP BY case_id, topic
HAVING count(CASE WHEN stance = 'SUPPORT' THEN 1 END) > 0 AND count(CASE WHEN stance = 'CONCERN' THEN 1 END) > 0"""


cte("curated_case", "SELECT case_id, id, source FROM case_evidence", "case_evidence")
cte("measures", f"""
SELECT c.case_id, c.symbol, c.decision_at, coalesce(e.records, 0) AS records, coalesce(e.sources, 0) AS sources,
       coalesce(e.records, 0) >= 2 AS sufficient, coalesce(q.cited / e.records, 0.0) AS coverage,
       coalesce(h.roles, 0) = 4 AS all_roles_present, coalesce(h.identity, true) AS report_identity,
       coalesce(q.strangers, 0) = 0 AS evidence_references, coalesce(e.sources, 0) >= 2 AS source_diversity,
       coalesce(q.cited / e.records, 0.0) >= 0.75 AS evidence_coverage, coalesce(k.high, 0) = 0 AS high_severity_contradictions
FROM cases c
LEFT JOIN (SELECT case_id, count(*) AS records, count(DISTINCT source) AS sources FROM curated_case GROUP BY ALL) e USING (case_id)
LEFT JOIN (SELECT r.case_id, count(DISTINCT r.role) AS roles, bool_and(r.symbol = c2.symbol) AS identity
           FROM reports r JOIN cases c2 USING (case_id) GROUP BY ALL) h USING (case_id)
LEFT JOIN (SELECT f.case_id, count(DISTINCT e.id) AS cited, count(DISTINCT CASE WHEN e.id IS NULL THEN f.citation END) AS strangers
           FROM trimmed_findings f LEFT JOIN curated_case e ON e.case_id = f.case_id AND e.id = f.citation GROUP BY ALL) q USING (case_id)
LEFT JOIN (SELECT case_id, count(CASE WHEN severity = 'HIGH' THEN 1 END) AS high FROM ({contradictions('trimmed_findings')})
           GROUP BY ALL) k USING (case_id)""", "cases", "curated_case", "reports", "trimmed_findings")
CHECKS = ("all_roles_present", "report_identity", "evidence_references", "source_diversity", "evidence_coverage",
          "high_severity_contradictions")
PASSES = "(" + " AND ".join(CHECKS) + ")"
cte("codes", f"""
SELECT case_id, 'INSUFFICIENT_EVIDENCE' AS code FROM measures WHERE NOT sufficient
UNION SELECT case_id, 'FAILURE_MODE:TimeoutError' FROM measures WHERE sufficient AND case_id % 13 = 12
UNION SELECT case_id, blocker FROM reports JOIN measures USING (case_id) WHERE sufficient AND blocker IS NOT NULL
UNION SELECT case_id, 'UNRESOLVED_HIGH_CONTRADICTION' FROM measures WHERE sufficient AND NOT high_severity_contradictions
UNION SELECT case_id, 'AUDIT_CHECK_FAILED' FROM measures WHERE sufficient AND NOT {PASSES}""", "measures", "reports")
cte("audits", f"""
SELECT m.*, coalesce(b.blockers, 0) AS blockers, sufficient AND {PASSES} AND coalesce(b.blockers, 0) = 0 AS approved,
       CASE WHEN sufficient THEN coverage ELSE 0.0 END AS final_coverage
FROM measures m LEFT JOIN (SELECT case_id, count(*) AS blockers FROM codes GROUP BY ALL) b USING (case_id)""", "measures", "codes")
cte("syntheses", """
SELECT c.case_id, CASE c.case_id % 3 WHEN 0 THEN 'SUPPORT' WHEN 1 THEN 'CONCERN' ELSE 'ABSTAIN' END AS verdict,
       c.case_id % 5 <> 4 OR (SELECT count(*) FROM reports r WHERE r.case_id = c.case_id) < 1 AS reports_equal,
       CASE WHEN c.case_id % 6 = 5 THEN ['e0', 'e9'] ELSE ['e0', 'e1'] END AS evidence_ids,
       (SELECT list(report_id ORDER BY report_id) FROM reports r WHERE r.case_id = c.case_id) AS ids
FROM cases c WHERE c.case_id % 8 <> 7""", "cases", "reports")
cte("valid_syntheses", """
SELECT case_id, verdict, reports_equal AND NOT EXISTS (
  SELECT 1 FROM (SELECT unnest(s.evidence_ids) AS id) x WHERE x.id NOT IN (SELECT id FROM curated_case e WHERE e.case_id = s.case_id)) AS valid
FROM syntheses s""", "syntheses", "curated_case")
cte("routed", """
SELECT case_id, symbol, decision_at, route, CASE WHEN route = 'SYNTHESIS_COMPLETE' THEN verdict END AS verdict FROM (
  SELECT a.*, v.verdict, CASE WHEN NOT sufficient THEN 'ABSTAIN_INSUFFICIENT_EVIDENCE' WHEN NOT approved THEN 'ABSTAIN_AUDIT_BLOCKED'
    WHEN valid IS NULL THEN 'ABSTAIN_SYNTHESIS_FAILED' WHEN NOT valid THEN 'ABSTAIN_SYNTHESIS_INVALID' ELSE 'SYNTHESIS_COMPLETE' END AS route
  FROM audits a LEFT JOIN valid_syntheses v USING (case_id))""", "audits", "valid_syntheses")


def bool_text(name: str) -> str:
    return f"CASE WHEN {name} THEN 'true' ELSE 'false' END"


HASH = f"sha256(concat_ws('|', {bool_text('approved')}, CAST(blockers AS VARCHAR), CAST(cov AS VARCHAR), CAST(records AS VARCHAR)))"
AUDIT_ROWS = f"SELECT case_id, records, blockers, approved, CAST(floor({r('final_coverage')} * 1000000) AS BIGINT) AS cov FROM audits"

cte("packets", f"""
SELECT decision, symbol, 'asset_' || lpad(CAST(row_number() OVER (PARTITION BY decision ORDER BY symbol) AS VARCHAR), 3, '0') AS id,
       momentum_63, momentum_126, volatility_63
FROM (SELECT symbol, session AS decision, i, {", ".join(
    f"{r(f'round(growth / lag(growth, {k}) OVER ({W}), 12) - 1', 8)} AS momentum_{k}" for k in (63, 126))},
             {r(f'stddev_pop(ret) OVER ({W} ROWS BETWEEN 61 PRECEDING AND CURRENT ROW) * sqrt(252)', 8)} AS volatility_63
      FROM (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret, row_number() OVER ({W}) - 1 AS i FROM panel_growth))
JOIN (SELECT session AS decision FROM schedule WHERE decides) USING (decision) WHERE i >= 126""", "panel_growth", "schedule")
cte("composite", """
SELECT *, row_number() OVER (PARTITION BY decision ORDER BY score DESC, id) AS position
FROM (SELECT *, round(momentum_63 + momentum_126 - 0.25 * volatility_63, 12) AS score FROM packets)""", "packets")
cte("answers", """
SELECT decision, list_concat(ids[1:4], ['asset_999'], ids[2:2], ids[5:]) AS ids FROM (
  SELECT decision, list(id ORDER BY token, id) AS ids
  FROM (SELECT decision, id, md5(CAST(decision AS VARCHAR) || ':' || id) AS token FROM packets) WHERE token < 'a' GROUP BY decision)""",
    "packets")
cte("named", """
SELECT decision, id, min(place) AS place FROM (SELECT decision, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM answers)
GROUP BY ALL""", "answers")
cte("rankings", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY src, place) AS position,
                      count(CASE WHEN src = 0 THEN 1 END) OVER (PARTITION BY decision) AS valid FROM (
  SELECT decision, id, 0 AS src, place FROM named SEMI JOIN packets USING (decision, id)
  UNION ALL SELECT decision, id, 1, position FROM composite SEMI JOIN answers USING (decision) ANTI JOIN named USING (decision, id)))
WHERE src = 0 OR position <= 20""", "named", "composite")

SQL = {
    "evidence_checks": with_("symbols evidence", f"""
SELECT {N.replace('symbol', 's.symbol')}::BIGINT AS case_id, CASE WHEN id IS NULL THEN 'evidence_present' ELSE 'evidence:' || id END AS "check",
       coalesce({FRESH}, false) AS passed
FROM symbols s LEFT JOIN (SELECT * FROM evidence WHERE symbol <> 'Brand-7') e ON e.symbol = s.symbol"""),
    "evidence_all_pass": with_("symbols evidence", f"""
SELECT {N.replace('symbol', 's.symbol')}::BIGINT AS case_id, coalesce(bool_and({FRESH}), false) AS passed
FROM symbols s LEFT JOIN (SELECT * REPLACE (CASE WHEN {N} % 2 = 0 THEN TIMESTAMP '2001-05-01' ELSE available_to_strategy_at END AS available_to_strategy_at,
                          CASE WHEN {N} % 4 = 0 THEN 'PASS' ELSE quality END AS quality) FROM evidence) e
ON e.symbol = s.symbol GROUP BY 1"""),
    "curated_evidence": with_("symbols evidence", f"""
SELECT case_id, min(id) AS id, source, available_to_strategy_at FROM (
  SELECT {N}::BIGINT AS case_id, id, source, available_to_strategy_at, {NORMAL} AS text FROM evidence WHERE {FRESH})
GROUP BY case_id, source, available_to_strategy_at, text"""),
    "evidence_sufficiency": with_("measures", "SELECT case_id, symbol, records, sources, sufficient FROM measures"),
    "audit_checks": with_("measures", " UNION ALL ".join(
        f"SELECT case_id, '{c}' AS \"check\", {c} AS passed FROM measures WHERE sufficient" for c in CHECKS)
        + " UNION ALL SELECT case_id, 'evidence_completeness', false FROM measures WHERE NOT sufficient"),
    "blocker_codes": with_("codes", "SELECT case_id, code FROM codes"),
    "case_audits": with_("audits", f"SELECT case_id, records, {r('final_coverage')} AS coverage, blockers, approved FROM audits"),
    "contradictions": with_("findings", contradictions("findings")),
    "contradiction_reports": with_("findings", f"""
SELECT DISTINCT case_id, topic, stance, report_id FROM findings SEMI JOIN ({contradictions('findings')}) USING (case_id, topic)
WHERE stance IN ('SUPPORT', 'CONCERN')"""),
    "unknown_citations": with_("trimmed_findings curated_case", """
SELECT DISTINCT f.case_id, f.citation AS id FROM trimmed_findings f
ANTI JOIN curated_case e ON e.case_id = f.case_id AND e.id = f.citation"""),
    "synthesis_validation": with_("valid_syntheses", "SELECT case_id, verdict, valid FROM valid_syntheses"),
    "case_routes": with_("routed", "SELECT * FROM routed"),
    "case_approvals": with_("routed", "SELECT case_id, symbol, decision_at, coalesce(verdict = 'SUPPORT', false) AS approved FROM routed"),
    "outcome_counts": with_("routed", """
SELECT route, verdict, count(*) AS cases FROM (SELECT route, coalesce(verdict, 'NONE') AS verdict FROM routed)
GROUP BY ROLLUP (route, verdict)"""),
    "audited_results": with_("audits", f"""
SELECT case_id, {HASH} AS payload_hash, CASE WHEN case_id % 3 <> 0 THEN 'NEW' WHEN case_id % 9 = 0 THEN 'CONFLICT' ELSE 'SAME' END AS outcome
FROM ({AUDIT_ROWS})"""),
    "stored_result_check": with_("audits", "SELECT case_id FROM audits WHERE case_id % 4 = 1"),
    "finding_validity": with_("findings", f"""
SELECT report_id, turn, violations FROM (SELECT report_id, turn, {broken([
    ('claim_length', 'length(factual_claim) BETWEEN 1 AND 500'), ('interpretation_length', 'length(factual_claim) BETWEEN 1 AND 500')])} AS violations
  FROM findings) WHERE violations <> ''"""),
    "report_validity": with_("reports", "SELECT report_id, 'prompt_version' AS violations FROM reports WHERE prompt_version = ''"),
    "synthesis_validity": with_("syntheses", f"""
SELECT case_id, violations FROM (SELECT case_id, {broken([
    ('summary_length', 'case_id % 4 <> 3'),
    ('names_reports', 'len(list_filter(CASE WHEN case_id % 5 = 4 THEN ids[2:] ELSE ids END, lambda x: x % 4 <> case_id % 4)) >= 1'),
    ('names_evidence', 'case_id % 6 <> 2'), ('known_verdict', 'case_id % 5 <> 3')])} AS violations FROM syntheses)
WHERE violations <> ''"""),
    "composite_ranking": with_("composite", f"SELECT decision, id, symbol, {r('score')} AS score, position FROM composite"),
    "normalized_rankings": with_("rankings", """
SELECT decision, id, position, CASE WHEN src = 0 THEN 'ranker' ELSE 'fallback' END AS source FROM rankings"""),
    "ranking_portfolio": with_("rankings packets", f"""
SELECT decision, symbol, position, {r('1.0 / count(*) OVER (PARTITION BY decision)')} AS weight
FROM rankings JOIN aliases USING (decision, id) SEMI JOIN (SELECT decision FROM aliases GROUP BY ALL HAVING count(*) >= 6) USING (decision)
WHERE position <= 6""", aliases="SELECT decision, id, symbol FROM packets WHERE month(decision) <> 8 OR symbol < 'Brand-12'"),
    "ranked_strategy_sweep": sweep("SELECT * FROM curve", METRICS + HITS, "panel_momentum schedule bench rankings packets composite", {"reviewed_list": f"""
SELECT decision, symbol, 1.0 / count(*) OVER (PARTITION BY decision) AS weight FROM (
  SELECT decision, symbol, row_number() OVER (PARTITION BY decision ORDER BY position) AS place FROM composite
  WHERE position <= 15 AND {N} % 4 > 0 AND ({N} * 7 + month(decision)) % 3 > 0) WHERE place <= 6""", "ranked_list": """
SELECT decision, symbol, 1.0 / count(*) OVER (PARTITION BY decision) AS weight
FROM rankings JOIN packets USING (decision, id) WHERE position <= 6"""}),
    "unknown_ranking_ids": with_("answers packets", """
SELECT decision, id FROM (SELECT decision, unnest(ids) AS id FROM answers) ANTI JOIN packets USING (decision, id)"""),
    "gated_selection": with_("composite", f"""
SELECT decision, symbol, place, {r('1.0 / count(*) OVER (PARTITION BY decision)')} AS weight FROM (
  SELECT decision, symbol, row_number() OVER (PARTITION BY decision ORDER BY position) AS place FROM composite
  WHERE position <= 15 AND {N} % 4 > 0 AND ({N} * 7 + month(decision)) % 3 > 0) WHERE place <= 6"""),
}
