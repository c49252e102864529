"""Queries of run decisions. Runs are derived from orders, one a row, so that counts reach every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import verdicts
from weft.plans.tables import derived, derived_sql, registrar, table

QUERIES, SQL, query = registrar()

#: A run's counts, read alike by both engines.
RUN = {
    "receipts": "case when o_orderkey % 41 = 0 then 0 else o_orderkey % 47 end",
    "claims": "case when o_orderkey % 29 = 0 then 0 else o_orderkey % 137 end",
    "tensions": "o_orderkey % 23",
    "classes": "o_orderkey % 15",
    "direct_n": "o_orderkey % 5",
    "high": "o_orderkey % 4",
    "largest": "o_orderkey % 19",
    "total": "cast(o_orderkey % 19 as double)",
    "clinical": "cast(o_orderkey % 13 as double)",
    "mechanistic": "cast(o_orderkey % 11 as double)",
    "direct": "cast(o_orderkey % 3 as double) / 2",
    "a_tier": "cast(o_orderkey % 5 as double) / 4",
    "a1_direct": "o_orderkey % 2",
    "n_mechanistic": "o_orderkey % 9",
    "bridges": "o_orderkey % 6",
    "p1_pass": "o_orderkey % 7 <> 0",
    "checks": "case when o_orderkey % 31 = 0 then 0 else 14 end",
    "passed": "case when o_orderkey % 31 = 0 then 0 when o_orderkey % 8 = 0 then 13 else 14 end",
    "severity": "case o_orderkey % 17 when 0 then 'P1' when 1 then 'P2' when 2 then 'P3' when 3 then 'ODD' when 4 then 'CRITICAL' when 5 then 'INFO' else 'NONE' end",
    "unresolved": "case when o_orderkey % 12 = 0 then 1 when o_orderkey % 37 = 0 then 2 else 0 end",
    "flagged": "case when o_orderkey % 10 = 3 then 1 else 0 end",
    "stripped": "case when o_orderkey % 14 = 5 then 2 else 0 end",
    "surface": "o_orderkey % 16 <> 7",
}
_RUN = f"r as {derived_sql('orders', RUN, 'o_orderkey')}"
_FLAT = "(receipts >= 10 and claims >= 50 and tensions >= 10)"
_TRACK = f"""case when {_FLAT} then case when mechanistic > clinical and direct < 1.0 then 'AAA-MECH' else 'AAA-CLIN' end when receipts >= 2 and receipts < 10 and claims > 0 and a1_direct >= 1 then 'AAA-SCOP'
    when receipts < 10 or claims < 50 then 'SCOP' when total >= 8.0 and a_tier >= 0.7 and mechanistic >= 2.0 then 'AAA-INF' when total >= 6.0 and mechanistic >= 6.0 and n_mechanistic >= 5 then 'AAA-MECH' else 'SCOP' end"""
_VERDICTS = f"""{_RUN}, t as (select *, {_TRACK} as track, severity in ('P1', 'CRITICAL', 'ODD') as blocks from r),
    v as (select *, track like 'AAA%' as clean, case when not p1_pass or blocks then 'SHIP-BLOCKED' when unresolved = 0 and checks > 0 and passed = checks and severity <> 'P2' and track like 'AAA%' and (track not in ('AAA-INF', 'AAA-MECH') or bridges >= 3) then 'AAA'
      when unresolved > 0 then 'Trust-Spine Pass — Agent Review Unresolved' else 'Trust-Spine Pass' end as verdict from t),
    m as (select *, case when receipts = 0 then 0 when claims = 0 then 1 when not {_FLAT} then 2 when verdict <> 'AAA' then 3 when unresolved = 0 and flagged = 0 and stripped = 0 and surface then 5 else 4 end as level from v)"""


def runs(spark, sf_dir):
    return derived(table(spark, sf_dir, "orders"), RUN, "o_orderkey")


def _c(*names):
    return [F.col(n) for n in names]


def judged(spark, sf_dir):
    """Runs with their track, verdict and level."""
    r = runs(spark, sf_dir)
    profile = {k: F.col(k) for k in ("total", "clinical", "mechanistic", "direct", "a_tier", "a1_direct", "n_mechanistic")}
    r = r.withColumn("c", verdicts.certification(*_c("receipts", "claims", "tensions"), profile)).select("*", "c.track", "c.clean").drop("c")
    severities = F.filter(F.array("severity"), lambda s: s != "NONE")
    r = r.withColumn("verdict", verdicts.unified_verdict(*_c("p1_pass", "passed", "checks"), severities, *_c("unresolved", "track", "clean", "bridges")))
    return r.withColumn("level", verdicts.maturity(*_c("receipts", "claims", "tensions", "verdict", "unresolved", "flagged", "stripped", "surface")))


@query("certification_track", f"with {_VERDICTS} select o_orderkey, track, clean from v")
def certification_track(spark, sf_dir):
    return judged(spark, sf_dir).select("o_orderkey", "track", "clean")


@query("unified_verdict", f"with {_VERDICTS} select o_orderkey, verdict from v")
def unified_verdict(spark, sf_dir):
    return judged(spark, sf_dir).select("o_orderkey", "verdict")


_LABELS = "['L0 — UNSEEDED', 'L1 — SEEDED', 'L2 — PARTIAL', 'L3 — FLOOR-MET', 'L4 — ANALYTICALLY CERTIFIED', 'L5 — JOURNAL-READY']"


@query("maturity_level", f"with {_VERDICTS} select o_orderkey, level, ({_LABELS})[level + 1] as label from m")
def maturity_level(spark, sf_dir):
    return judged(spark, sf_dir).select("o_orderkey", "level", verdicts.maturity_label(F.col("level")).alias("label"))


@query("field_eligibility", f"with {_VERDICTS} select o_orderkey, case when verdict <> 'AAA' then 'excluded' when contains(track, 'SCOP') then 'scoped_support' when level >= 5 and surface then 'full_aaa_primary' when level >= 4 then 'analytical_support' else 'scoped_support' end as eligibility from m")
def field_eligibility(spark, sf_dir):
    return judged(spark, sf_dir).select("o_orderkey", verdicts.eligibility(*_c("verdict", "track", "level", "surface")).alias("eligibility"))


_PROFILE = "(case tier when 'A1' then 1.0 when 'A2' then 0.7 when 'B1' then 0.6 when 'B' then 0.5 when 'B2' then 0.4 when 'C1' then 0.3 when 'C' then 0.25 when 'C2' then 0.2 when 'D1' then 0.1 when 'MIXED' then 0.3 else 0.2 end)::double"
RECEIPT = {
    "tier": "case l_partkey % 11 when 0 then 'A1' when 1 then 'A2' when 2 then 'B1' when 3 then 'B' when 4 then 'B2' when 5 then 'C1' when 6 then 'C' when 7 then 'C2' when 8 then 'D1' when 9 then 'MIXED' else 'X' end",
    "directness": "case l_linenumber % 4 when 0 then 'direct' when 1 then 'mechanistic' when 2 then 'review' else 'indirect' end",
}


@query("certification_profile", f"""with r as {derived_sql('lineitem', RECEIPT, 'l_suppkey')}, w as (select *, {_PROFILE} as w, directness = 'mechanistic' or tier like 'C%' as model from r)
    select l_suppkey, round(sum(w), 4) as total, round(sum(case when (tier like 'A%' or tier like 'B%') and directness <> 'mechanistic' then w else 0 end), 4) as clinical, round(sum(case when model then w else 0 end), 4) as mechanistic, round(sum(case when directness = 'direct' then w else 0 end), 4) as direct,
      round(sum(case when tier like 'A%' then w else 0 end), 4) as a_tier, count(*) filter (where directness = 'direct' and tier = 'A1') as a1_direct, count(*) filter (where model) as n_mechanistic from w group by l_suppkey""")
def certification_profile(spark, sf_dir):
    return verdicts.evidence_profile(derived(table(spark, sf_dir, "lineitem"), RECEIPT, "l_suppkey"), "l_suppkey")


@query("corpus_gaps", f"""with {_RUN} select o_orderkey, array_to_string(list_filter([case when receipts < 10 then 'receipts' end, case when claims < 50 then 'claims' end, case when tensions < 10 then 'tensions' end, case when receipts > 0 and classes < 3 then 'outcome_classes' end,
    case when receipts > 0 and direct_n < 2 then 'direct_receipts' end, case when receipts > 0 and high < 2 then 'high_tier_receipts' end, case when receipts >= 3 and largest / receipts > 0.4 then 'single_paper' end], lambda x: x is not null), ',') as gaps from r""")
def corpus_gaps(spark, sf_dir):
    return runs(spark, sf_dir).select("o_orderkey", F.array_join(verdicts.corpus_gaps(*_c("receipts", "claims", "tensions", "classes", "direct_n", "high", "largest")), ",").alias("gaps"))


PAPER = {
    "receipts": "o_orderkey % 43", "classes": "o_orderkey % 4", "tensions": "o_orderkey % 5", "numeric": "case o_orderkey % 7 when 0 then 0.7 when 1 then 0.9 when 2 then 0.97 when 3 then 0.82 else 1.0 end",
    "rob": "case o_orderkey % 3 when 0 then 0.4 when 1 then 0.6 else 0.9 end", "grade": "case when o_orderkey % 2 = 0 then 1.0 else 0.5 end", "cited_all": "o_orderkey % 9 <> 0", "audited": "o_orderkey % 10 <> 0", "template": "o_orderkey % 6 = 0",
    "engaged": "o_orderkey % 3", "frameworks": "case when o_orderkey % 8 = 0 then 0 else 2 end", "thesis": "o_orderkey % 5 <> 1", "limitations": "o_orderkey % 13 <> 0", "practice": "o_orderkey % 4 <> 3", "unresolved": "case when o_orderkey % 11 = 0 then 1 when o_orderkey % 17 = 0 then 2 else 0 end",
    "surface": "o_orderkey % 12 <> 5", "kind": "case o_orderkey % 5 when 0 then 'evidence_map' when 1 then 'curated_evidence_map' when 2 then 'systematic_review' when 3 then 'prisma_scr_scoping_synthesis' else 'narrative_review' end",
}
_PAPER = f"p0 as {derived_sql('orders', PAPER, 'o_orderkey')}, p as (select *, kind not in ('prisma_scr_scoping_synthesis', 'curated_evidence_map') as appraised from p0)"
_CARD = f"""{_PAPER}, s as (select *, case when thesis then 3 else 0 end + case when classes >= 2 then 2 when classes = 1 then 1 else 0 end as q1,
      case when receipts >= 30 then 3 when receipts >= 12 then 2 when receipts >= 5 then 1 else 0 end + case when tensions >= 3 then 2 when tensions >= 1 then 1 else 0 end as q2,
      least(5, case when limitations then 2 else 0 end + case when frameworks = 0 then 1 when engaged < frameworks then 2 else 1 end + case when tensions >= 1 then 1 else 0 end) as q3,
      case when numeric >= 1 then 3 when numeric >= 0.95 then 2 when numeric >= 0.8 then 1 else 0 end + case when audited then 1 else 0 end + case when not template then 1 else 0 end as q4,
      case when limitations then 2 else 0 end + case when practice then 2 else 0 end + case when not appraised or rob >= 0.5 then 1 else 0 end as q5,
      case when cited_all then 2 else 0 end + case when not appraised then 2 when rob >= 0.8 then 1 else 0 end + case when appraised and grade >= 1 then 1 else 0 end + case when frameworks = 0 or engaged >= 1 then 1 else 0 end as q6 from p),
    c as (select *, q1 + q2 + q3 + q4 + q5 + q6 as total, case when numeric >= 1 and audited and cited_all and unresolved = 0 then 'supported' when numeric >= 0.85 and unresolved <= 1 then 'partially_supported' else 'unsupported' end as claim_support,
      case when template and unresolved >= 1 then 'severe' when template then 'mild' else 'none' end as overclaim from s)"""


def papers(spark, sf_dir):
    return derived(table(spark, sf_dir, "orders"), PAPER, "o_orderkey").withColumn("appraised", verdicts.appraised(F.col("kind")))


@query("publication_score", f"""with {_CARD} select o_orderkey, q1 as research_question, q2 as synthesis, q3 as gaps, q4 as claim_evidence, q5 as limitations, q6 as source_grounding, total, claim_support, overclaim,
    case when total >= 27 and claim_support = 'supported' and overclaim = 'none' then 'accept' when total >= 18 and claim_support <> 'unsupported' then 'revise' else 'reject' end as verdict,
    array_to_string(list_filter([case when total < 27 then 'total' end, case when claim_support <> 'supported' then 'claim_support' end, case when overclaim <> 'none' then 'overclaim' end], lambda x: x is not null), ',') as blockers from c""")
def publication_score(spark, sf_dir):
    p = papers(spark, sf_dir)
    card = verdicts.scorecard({c: F.col(c) for c in p.columns})
    return p.select("o_orderkey", *[v.alias(k) for k, v in card.items() if k != "blockers"], F.array_join(card["blockers"], ",").alias("blockers"))


@query("final_gate", f"""with {_PAPER}, t as (select *, case when appraised then 0.8 else 0 end as need_rob, case when appraised then 1.0 else 0 end as need_grade, case when kind = 'evidence_map' and receipts > 0 and tensions <= 0 then 0 else 1 end as need_tensions from p)
    select o_orderkey, array_to_string(list_filter([case when not audited then 'audit_gates' end, case when not surface then 'journal_surface' end, case when unresolved > 0 then 'unresolved_review' end, case when numeric < 1 then 'numeric_coverage' end, case when not cited_all then 'citation_registry' end,
      case when rob < need_rob then 'rob_coverage' end, case when grade < need_grade then 'grade_coverage' end, case when tensions < need_tensions then 'tensions' end, case when receipts < 12 then 'receipts' end, case when template then 'template_language' end], lambda x: x is not null), ',') as failures,
      case when receipts < 30 then 'few_receipts' else '' end as warnings from t""")
def final_gate(spark, sf_dir):
    p = papers(spark, sf_dir)
    i = {c: F.col(c) for c in p.columns}
    fails, warns = verdicts.final_gate(i, verdicts.gate_thresholds(i["kind"], i["receipts"], i["tensions"]))
    return p.select("o_orderkey", F.array_join(fails, ",").alias("failures"), F.array_join(warns, ",").alias("warnings"))


STAGES = {"runtime": "o_orderkey % 9 <> 0", "audit": "o_orderkey % 8 <> 0", "surface": "o_orderkey % 7 <> 0", "pre_submit": "o_orderkey % 6 <> 0", "journal": "o_orderkey % 5 <> 0", "accountable": "o_orderkey % 4 <> 0"}


@query("final_level", f"with s as {derived_sql('orders', STAGES, 'o_orderkey')} select o_orderkey, case when not runtime then 1 when not audit then 2 when not surface then 3 when not pre_submit then 3 when not (journal and accountable) then 4 else 5 end as level from s")
def final_level(spark, sf_dir):
    return derived(table(spark, sf_dir, "orders"), STAGES, "o_orderkey").select("o_orderkey", verdicts.final_level(*_c(*STAGES)).alias("level"))


#: Artifacts as JSON text, of the shapes that there are, and of none.
ARTIFACTS = {
    "audit": """case o_orderkey % 6 when 0 then '{"all_pass": true}' when 1 then '{"pass_count": 14, "total_count": 14}' when 2 then '{"n_pass": 14, "n_total": 14, "p1_pass": false}' when 3 then '{"n_pass": 13, "n_total": 14}' when 4 then '{"n_pass": 0, "n_total": 0}' else null end""",
    "surface": """case o_orderkey % 5 when 0 then '{"pass": false, "verdict": "ok"}' when 1 then '{"passed": true}' when 2 then '{"verdict": "CLEAN"}' when 3 then '{"verdict": "odd"}' else null end""",
    "review": """case o_orderkey % 4 when 0 then '{"unresolved_p1_count": 3}' when 1 then '{"patches": [{"severity": "p1", "status": "open"}, {"severity": "P1", "status": "Applied"}, {"severity": "P2"}]}' when 2 then '{"patches": []}' else '{}' end""",
}


@query("gate_inputs", f"""with a as {derived_sql('orders', ARTIFACTS, 'o_orderkey')} select o_orderkey, coalesce(json_extract_string(audit, '$.all_pass') = 'true', false) or coalesce(coalesce(json_extract(audit, '$.pass_count'), json_extract(audit, '$.n_pass'))::int = coalesce(json_extract(audit, '$.total_count'), json_extract(audit, '$.n_total'))::int
      and coalesce(json_extract(audit, '$.total_count'), json_extract(audit, '$.n_total'))::int > 0 and coalesce(json_extract_string(audit, '$.p1_pass'), 'true') = 'true', false) as audited,
    coalesce(coalesce(json_extract_string(surface, '$.pass'), json_extract_string(surface, '$.passed')) = 'true', lower(json_extract_string(surface, '$.verdict')) in ('pass', 'passed', 'ok', 'clean'), false) as surfaced,
    coalesce(json_extract(review, '$.unresolved_p1_count')::bigint, case when json_extract(review, '$.patches') is not null then len(list_filter(json_extract(review, '$.patches[*]'), lambda p: upper(json_extract_string(p, '$.severity')) = 'P1' and lower(coalesce(json_extract_string(p, '$.status'), '')) not in ('applied', 'resolved', 'auto_strip'))) end) as unresolved from a""")
def gate_inputs(spark, sf_dir):
    a = derived(table(spark, sf_dir, "orders"), ARTIFACTS, "o_orderkey")
    return a.select("o_orderkey", verdicts.audit_passed(F.col("audit")).alias("audited"), verdicts.surface_passed(F.col("surface")).alias("surfaced"), verdicts.unresolved_reviews(F.col("review")).alias("unresolved"))


CORPUS = {
    "receipts": "case when o_orderkey % 37 = 0 then 600 else o_orderkey % 40 end", "tensions": "case when o_orderkey % 41 = 0 then 60000 else o_orderkey % 3 end", "primary_n": "o_orderkey % 7 - 1", "classes": "o_orderkey % 14 - 1",
    "declared": "case o_orderkey % 6 when 0 then 'Systematic Review' when 1 then 'meta-analysis' when 2 then '' when 3 then 'poem' when 4 then 'thin corpus brief' else null end",
}
_CORPUS = f"c as {derived_sql('orders', CORPUS, 'o_orderkey')}"
_TOKEN = "case when trim(coalesce(declared, '')) = '' then 'prisma_scr_scoping_synthesis' when regexp_replace(lower(trim(declared)), '[- ]', '_', 'g') in ('systematic_review', 'meta_analysis', 'thin_corpus_brief') then regexp_replace(lower(trim(declared)), '[- ]', '_', 'g') end"


@query("review_type", f"""with {_CORPUS}, s as (select *, array_to_string(list_filter([case when receipts > 500 then 'n_receipts' end, case when tensions > 50000 then 'n_tensions' end, case when classes > 12 then 'n_outcome_classes' end], lambda x: x is not null), ',') as broad,
      array_to_string(list_filter([case when receipts < 10 then 'n_receipts' end, case when tensions < 1 then 'n_tensions' end, case when primary_n >= 0 and primary_n < 3 then 'n_primary_tier' end], lambda x: x is not null), ',') as thin from c)
    select o_orderkey, broad, thin, case when broad <> '' then 'evidence_map' when thin = '' then {_TOKEN} when receipts >= 10 and tensions >= 1 then 'evidence_brief' else 'thin_corpus_brief' end as review_type from s""")
def review_type(spark, sf_dir):
    c = derived(table(spark, sf_dir, "orders"), CORPUS, "o_orderkey")
    return c.select(
        "o_orderkey", F.array_join(verdicts.scope_reasons(*_c("receipts", "tensions", "classes")), ",").alias("broad"), F.array_join(verdicts.sufficiency_reasons(*_c("receipts", "tensions", "primary_n")), ",").alias("thin"),
        verdicts.review_type(*_c("declared", "receipts", "tensions", "primary_n", "classes")).alias("review_type"),
    )


CANDIDATE = {
    "declared": CORPUS["declared"], "manifest": "o_orderkey % 11 <> 0", "density_ok": "o_orderkey % 10 <> 0", "quant_claims": "o_orderkey % 9 * 4", "receipts": "o_orderkey % 8 * 4", "primary_tier": "o_orderkey % 7", "direct_receipts": "o_orderkey % 5", "precise": "o_orderkey % 6 <> 0",
    "status": "case o_orderkey % 13 when 0 then 'eligible' when 1 then 'published' when 2 then 'submitted' when 3 then 'submission_failed: x' when 4 then 'duplicate_title' when 5 then 'preflight_thin' when 6 then 'needs_corpus_more' when 7 then '' when 8 then null when 9 then 'public_research_surface_ok' else ' odd ' end",
}
_SURFACE = "case when trim(coalesce(declared, '')) = '' then 'research_synthesis' when regexp_replace(lower(trim(declared)), '[- ]', '_', 'g') in ('systematic_review', 'meta_analysis') then 'research_synthesis' else 'internal_compact' end"


@query("candidate_decision", f"""with c as (select *, {_SURFACE} as surface from {derived_sql('orders', CANDIDATE, 'o_orderkey')}), d as (select *, case when not manifest then 'latest_run_missing_manifest' when not density_ok then 'prior_numeric_density_failed' when quant_claims < 12 then 'quant_claims_below_floor' when receipts < 12 then 'receipts_below_floor'
      when primary_tier < 3 then 'primary_tier_below_floor' when direct_receipts < 2 then 'direct_receipts_below_floor' when not precise then 'source_topic_precision_low' end as b from c)
    select o_orderkey, case when surface = 'internal_compact' then 'internal_alpha' when b is not null then 'needs_corpus' else 'receipt_ready' end as state, case when surface = 'internal_compact' then 'public_research_surface_compact_review' else b end as blocker,
      surface = 'internal_compact' or b is not null as retryable, case when surface = 'internal_compact' then 'expand_corpus' when b is not null then 'repair_corpus' else 'synthesize' end as action from d""")
def candidate_decision(spark, sf_dir):
    c = derived(table(spark, sf_dir, "orders"), CANDIDATE, "o_orderkey")
    least = {"quant_claims": 12, "receipts": 12, "primary_tier": 3, "direct_receipts": 2}
    return c.select("o_orderkey", verdicts.candidate_decision(F.col("declared"), {k: F.col(k) for k in CANDIDATE}, least).alias("d")).select("o_orderkey", "d.*")


@query("status_decision", f"""with c as (select o_orderkey, {_SURFACE} as surface, trim(coalesce(nullif(status, ''), 'unknown')) as s from {derived_sql('orders', CANDIDATE, 'o_orderkey')})
    select o_orderkey, case when s = 'published' then 'terminal' when s = 'submitted' then 'submitted_pending' when s like 'submission_failed%' then 'operational_error' when s like 'duplicate_%' then 'terminal' when surface = 'internal_compact' then 'internal_alpha' when s in ('eligible', 'public_research_surface_ok') then 'publishable' when s like 'preflight_%' or s like 'needs_corpus%' then 'needs_corpus' else 'needs_revision' end as state,
      case when s in ('published', 'submitted') then null when s like 'submission_failed%' or s like 'duplicate_%' then s when surface = 'internal_compact' then 'public_research_surface_compact_review' when s in ('eligible', 'public_research_surface_ok') then null else s end as blocker,
      case when s = 'published' then false when s = 'submitted' or s like 'submission_failed%' then true when s like 'duplicate_%' then false when surface = 'internal_compact' then true when s in ('eligible', 'public_research_surface_ok') then false else s <> 'unknown' end as retryable,
      case when s = 'published' then 'none' when s = 'submitted' then 'poll_decision' when s like 'submission_failed%' then 'retry_operation' when s like 'duplicate_%' then 'stop' when surface = 'internal_compact' then 'expand_corpus' when s in ('eligible', 'public_research_surface_ok') then 'submit' when s like 'preflight_%' or s like 'needs_corpus%' then 'repair_corpus' else 'revise' end as action from c""")
def status_decision(spark, sf_dir):
    c = derived(table(spark, sf_dir, "orders"), CANDIDATE, "o_orderkey")
    return c.select("o_orderkey", verdicts.status_decision(*_c("declared", "status")).alias("d")).select("o_orderkey", "d.*")


INFERENCE = {
    "claim": "case o_orderkey % 7 when 0 then 'The agent improves healing' when 1 then '' when 2 then 'Doses of 5 units' else 'The agent acts on the pathway' end", "conservation": "case when o_orderkey % 11 = 0 then null else 'Shared pathway' end", "testability": "'A trial'",
    "confidence": "case o_orderkey % 5 when 0 then 'high' when 1 then 'medium' when 2 then 'sure' else 'low' end", "tier": "case when o_orderkey % 13 = 0 then 'C1' else 'D1_bridge' end",
    "anchor1": "concat('r', cast(o_orderkey % 30 as string))", "anchor2": "concat('r', cast(o_orderkey % 900 as string))", "canon1": "concat('c', cast(o_orderkey % 27 as string))", "human1": "case o_orderkey % 3 when 0 then 'none identified' when 1 then concat('r', cast(o_orderkey % 120 as string)) else 'None' end",
}


@query("inference_errors", f"""with i as {derived_sql('orders', INFERENCE, 'o_orderkey')}, r as (select 'r' || s_suppkey as id, case when s_acctbal > 5000 then 'positive' when s_acctbal < 0 then 'negative' else 'null' end as effect from supplier), k as (select 'c' || n_nationkey as id from nation),
    j as (select i.*, (select count(*) from r where r.id in (anchor1, anchor2)) as known_anchors, (select count(*) from r where r.id in (anchor1, anchor2) and effect = 'positive') as lifted, canon1 in (select id from k) as known_canon, human1 in (select id from r) as known_human, lower(human1) not in ('none', 'none identified') as has_human, claim || ' ' || coalesce(conservation || ' ', '') || testability as prose from i)
    select o_orderkey, array_to_string(list_filter([case when tier not like 'D1\\_%' escape '\\' then 'tier' end, case when confidence not in ('low', 'medium', 'high') then 'confidence' end, case when claim = '' or conservation is null then 'text_missing' end, case when known_anchors < (case when anchor1 = anchor2 then 1 else 2 end) then 'unknown_anchor' end,
      case when not known_canon then 'unknown_canon' end, case when has_human and not known_human then 'unknown_human_signal' end, case when confidence = 'high' and not has_human then 'high_without_human_signal' end, case when regexp_matches(prose, '(?i)\\b(benefits?|improves?|effective|protects?|extends?)\\b') and lifted = 0 then 'benefit_without_positive_anchor' end,
      case when regexp_matches(prose, '[0-9]') then 'new_number' end], lambda x: x is not null), ',') as errors from j""")
def inference_errors(spark, sf_dir):
    i = derived(table(spark, sf_dir, "orders"), INFERENCE, "o_orderkey")
    claims = i.select(F.col("o_orderkey").alias("id"), "claim", "conservation", "testability", "confidence", "tier", F.array("anchor1", "anchor2").alias("anchors"), F.array("canon1").alias("canon_refs"), F.array("human1").alias("human"))
    s = table(spark, sf_dir, "supplier")
    receipts = s.select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_acctbal") > 5000, "positive").when(F.col("s_acctbal") < 0, "negative").otherwise("null").alias("effect"))
    canon = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("id"))
    return verdicts.validated(claims, receipts, canon).select(F.col("id").alias("o_orderkey"), F.array_join("errors", ",").alias("errors"))
