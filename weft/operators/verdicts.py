"""Decisions about a topic's run: certification, verdict, maturity, scorecard and gates.

Each is a Column over one row of counts, so that any number of runs is decided in
one projection; evidence_profile() and validated() make such rows from receipts and
inferences. Floors may be raised by an override, never lowered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.classify import DEFAULT_WEIGHT, TIER_WEIGHT, lookup

# Floors, cut-offs and labels that verdicts depend on.
FLOORS = {"receipts": 10, "claims": 50, "tensions": 10}
INFERENCE = {"total": 8.0, "a_tier": 0.7, "mechanistic": 2.0}
MECHANISM = {"weight": 6.0, "count": 5}
BRIDGE_CLAIMS = 3
BRIDGED_TRACKS = ("AAA-INF", "AAA-MECH")
BLOCKING, HARMLESS = ("P0", "P1", "CRITICAL"), ("P2", "P3", "INFO")
LEVELS = ("L0 — UNSEEDED", "L1 — SEEDED", "L2 — PARTIAL", "L3 — FLOOR-MET", "L4 — ANALYTICALLY CERTIFIED", "L5 — JOURNAL-READY", "L6 — REPRODUCIBLY JOURNAL-READY")
GAPS = {"classes": 3, "direct": 2, "high": 2, "share": 0.4, "least_receipts": 3}
CITED_SOURCES, RECOMMENDED_SOURCES = 12, 30
ACCEPT, REVISE = 27, 18
COVERAGE = {"numeric": 1.0, "rob": 0.8, "grade": 1.0, "tensions": 1}
REVIEW_TYPES = (
    "prisma_scr_scoping_synthesis", "structured_evidence_synthesis", "narrative_review", "systematic_review", "meta_analysis", "technical_survey",
    "management_literature_review", "evidence_map", "curated_evidence_map", "evidence_brief", "thin_corpus_brief",
)
COMPACT_TYPES = ("thin_corpus_brief", "evidence_brief", "evidence_map")
UNAPPRAISED_TYPES = ("prisma_scr_scoping_synthesis", "curated_evidence_map")
THIN = {"n_receipts": 10, "n_tensions": 1, "n_primary_tier": 3}
BROAD = {"n_receipts": 500, "n_tensions": 50_000, "n_outcome_classes": 12}


def named(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in order; an unknown one does not."""
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())


def raised(kind: str, override: Column | int | None = None) -> Column:
    return F.greatest(F.lit(FLOORS[kind]), override if isinstance(override, Column) else F.lit(override or 0))


def token(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """A normalised token: the default for none, null for one that is not allowed."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[- ]", "_")
    return F.when(text == "", F.lit(default)).when(text.isin(*allowed), text)


def evidence_profile(receipts: DataFrame, by: str) -> DataFrame:
    """Weights by tier of receipts(by, tier, directness): one row for each group."""
    tier, kind = F.upper(F.coalesce("tier", F.lit(""))), F.lower(F.coalesce("directness", F.lit("")))
    weight = lookup(TIER_WEIGHT | {"MIXED": 0.3}, tier, DEFAULT_WEIGHT)
    part = lambda c: F.round(F.sum(F.when(c, weight).otherwise(0.0)), 4)
    model = (kind == "mechanistic") | tier.startswith("C")
    return receipts.groupBy(by).agg(
        F.round(F.sum(weight), 4).alias("total"), part((tier.startswith("A") | tier.startswith("B")) & (kind != "mechanistic")).alias("clinical"), part(model).alias("mechanistic"),
        part(kind == "direct").alias("direct"), part(tier.startswith("A")).alias("a_tier"), F.count_if((kind == "direct") & (tier == "A1")).alias("a1_direct"), F.count_if(model).alias("n_mechanistic"),
    )


def floors_met(receipts: Column, claims: Column, tensions: Column, floors: dict[str, Column | int] | None = None) -> Column:
    over = floors or {}
    return (receipts >= raised("receipts", over.get("receipts"))) & (claims >= raised("claims", over.get("claims"))) & (tensions >= raised("tensions", over.get("tensions")))


def certification(receipts: Column, claims: Column, tensions: Column, profile: dict[str, Column], floors: dict[str, Column | int] | None = None) -> Column:
    """struct(track, clean): the first track whose floors hold; SCOP, not clean, if none does."""
    over, p = floors or {}, profile
    least_receipts, least_claims = raised("receipts", over.get("receipts")), raised("claims", over.get("claims"))
    flat = floors_met(receipts, claims, tensions, floors)
    says = lambda track, clean: F.struct(F.lit(track).alias("track"), F.lit(clean).alias("clean"))
    # Weights that a pack sets stand in place of the usual ones, higher or lower.
    weight = lambda kind, usual: F.coalesce(over[kind] if isinstance(over.get(kind), Column) else F.lit(over.get(kind)), F.lit(usual))
    inferred, mechanical = weight("inferential_weight", INFERENCE["total"]), weight("mechanistic_weight", MECHANISM["weight"])
    inference = (p["total"] >= inferred) & (p["a_tier"] >= INFERENCE["a_tier"]) & (p["mechanistic"] >= INFERENCE["mechanistic"])
    mechanism = (p["total"] >= mechanical) & (p["mechanistic"] >= mechanical) & (p["n_mechanistic"] >= MECHANISM["count"])
    return (
        F.when(flat & (p["mechanistic"] > p["clinical"]) & (p["direct"] < 1.0), says("AAA-MECH", True))
        .when(flat, says("AAA-CLIN", True))
        .when((receipts >= 2) & (receipts < least_receipts) & (claims > 0) & (p["a1_direct"] >= 1), says("AAA-SCOP", True))
        .when((receipts < least_receipts) | (claims < least_claims), says("SCOP", False))
        .when(inference, says("AAA-INF", True))
        .when(mechanism, says("AAA-MECH", True))
        .otherwise(says("SCOP", False))
    )


def blocking(severities: Column) -> Column:
    """How many issues block: those of a blocking severity, and of an unknown one."""
    return F.size(F.filter(severities, lambda s: s.isin(*BLOCKING) | ~F.coalesce(s.isin(*HARMLESS), F.lit(False))))


def unified_verdict(p1_pass: Column, passed: Column, checks: Column, severities: Column, unresolved: Column, track: Column, floor_clean: Column, bridges: Column, least_bridges: Column | int = BRIDGE_CLAIMS) -> Column:
    """SHIP-BLOCKED, AAA, or a pass of the trust spine, with the reviews that are open named.

    floor_clean says that the flat floors or the track's hold; a bridged track also
    needs its bridge claims, of which a pack may ask another number. All-green needs a check that ran.
    """
    clean = p1_pass & (blocking(severities) == 0)
    bridged = ~track.isin(*BRIDGED_TRACKS) | (bridges >= least_bridges)
    notes = F.size(F.filter(severities, lambda s: s == "P2"))
    green = clean & (unresolved == 0) & (checks > 0) & (passed == checks) & (notes == 0) & floor_clean & bridged
    return (
        F.when(~clean, "SHIP-BLOCKED").when(green, "AAA")
        .when(unresolved > 0, "Trust-Spine Pass — Agent Review Unresolved").otherwise("Trust-Spine Pass")
    )


def maturity(receipts: Column, claims: Column, tensions: Column, verdict: Column, unresolved: Column, flagged: Column, stripped: Column, surface: Column, floors: dict[str, Column | int] | None = None) -> Column:
    """0 to 5: seeded, extracted, floors, verdict, and no scar of repair."""
    unscarred = (unresolved == 0) & (flagged == 0) & (stripped == 0) & surface
    return (
        F.when(receipts == 0, 0).when(claims == 0, 1).when(~floors_met(receipts, claims, tensions, floors), 2)
        .when(verdict != "AAA", 3).when(unscarred, 5).otherwise(4)
    )


def maturity_label(level: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), level), F.concat(F.lit("L"), level.cast("string"), F.lit(" — UNKNOWN")))


def final_level(runtime: Column, audit: Column, surface: Column, pre_submit: Column, journal: Column, accountable: Column) -> Column:
    """1 to 5: the first of the stages that does not hold."""
    return F.when(~runtime, 1).when(~audit, 2).when(~surface | ~pre_submit, 3).when(~(journal & accountable), 4).otherwise(5)


def corpus_gaps(receipts: Column, claims: Column, tensions: Column, classes: Column, direct: Column, high: Column, largest: Column, floors: dict[str, Column | int] | None = None) -> Column:
    """Names of unmet thresholds, quantity before quality; quality counts only where there are receipts.

    largest is the number of receipts of the paper that has most.
    """
    over, some = floors or {}, receipts > 0
    return named({
        "receipts": receipts < raised("receipts", over.get("receipts")),
        "claims": claims < raised("claims", over.get("claims")),
        "tensions": tensions < raised("tensions", over.get("tensions")),
        "outcome_classes": some & (classes < GAPS["classes"]),
        "direct_receipts": some & (direct < GAPS["direct"]),
        "high_tier_receipts": some & (high < GAPS["high"]),
        "single_paper": (receipts >= GAPS["least_receipts"]) & (largest / F.greatest(receipts, F.lit(1)) > GAPS["share"]),
    })


def _ladder(x: Column, steps: list[tuple[float, int]]) -> Column:
    """Points of the first step that x reaches, else none."""
    out = F.lit(0)
    for least, points in reversed(steps):
        out = F.when(x >= least, points).otherwise(out)
    return out


def _points(c: Column, n: int) -> Column:
    return F.when(c, n).otherwise(0)


def scorecard(i: dict[str, Column]) -> dict[str, Column]:
    """Six parts of 0 to 5, their total, claim support, overclaim, verdict and blockers.

    i has receipts, classes, tensions, numeric, rob, grade, cited_all, audited,
    template, engaged, frameworks, thesis, limitations, practice, unresolved and
    appraised (whether formal appraisal is required).
    """
    engaged_all = i["engaged"] >= i["frameworks"]
    parts = {
        "research_question": _points(i["thesis"], 3) + _ladder(i["classes"], [(2, 2), (1, 1)]),
        "synthesis": _ladder(i["receipts"], [(30, 3), (CITED_SOURCES, 2), (5, 1)]) + _ladder(i["tensions"], [(3, 2), (1, 1)]),
        # A field without named frameworks is not marked down for them.
        "gaps": _points(i["limitations"], 2) + F.when((i["frameworks"] == 0) | engaged_all, 1).otherwise(2) + _points(i["tensions"] >= 1, 1),
        "claim_evidence": _ladder(i["numeric"], [(1.0, 3), (0.95, 2), (0.8, 1)]) + _points(i["audited"], 1) + _points(~i["template"], 1),
        "limitations": _points(i["limitations"], 2) + _points(i["practice"], 2) + _points(~i["appraised"] | (i["rob"] >= 0.5), 1),
        "source_grounding": _points(i["cited_all"], 2) + F.when(~i["appraised"], 2).otherwise(_points(i["rob"] >= 0.8, 1) + _points(i["grade"] >= 1.0, 1)) + _points((i["frameworks"] == 0) | (i["engaged"] >= 1), 1),
    }
    parts = {k: F.least(F.lit(5), v) for k, v in parts.items()}
    total = sum(parts.values(), F.lit(0))
    support = (
        F.when((i["numeric"] >= 1.0) & i["audited"] & i["cited_all"] & (i["unresolved"] == 0), "supported")
        .when((i["numeric"] >= 0.85) & (i["unresolved"] <= 1), "partially_supported").otherwise("unsupported")
    )
    overclaim = F.when(~i["template"], "none").when(i["unresolved"] >= 1, "severe").otherwise("mild")
    verdict = F.when((total >= ACCEPT) & (support == "supported") & (overclaim == "none"), "accept").when((total >= REVISE) & (support != "unsupported"), "revise").otherwise("reject")
    blockers = named({"total": total < ACCEPT, "claim_support": support != "supported", "overclaim": overclaim != "none"})
    return parts | {"total": total, "claim_support": support, "overclaim": overclaim, "verdict": verdict, "blockers": blockers}


def appraised(review_type: Column) -> Column:
    return ~review_type.isin(*UNAPPRAISED_TYPES)


def gate_thresholds(review_type: Column, receipts: Column, tensions: Column) -> dict[str, Column]:
    """Coverage that the final gate asks for: none of appraisal where the method has none,
    no tension of an evidence map that found none."""
    bare_map = (review_type == "evidence_map") & (receipts > 0) & (tensions <= 0)
    need = lambda k: F.when(appraised(review_type), COVERAGE[k]).otherwise(0.0)
    return {"numeric": F.lit(COVERAGE["numeric"]), "rob": need("rob"), "grade": need("grade"), "tensions": F.when(bare_map, 0).otherwise(COVERAGE["tensions"]), "receipts": F.lit(CITED_SOURCES)}


def final_gate(i: dict[str, Column], least: dict[str, Column]) -> tuple[Column, Column]:
    """(failures, warnings) of a run's signals against thresholds.

    i has audited, surface, unresolved, numeric, cited_all, rob, grade, tensions,
    receipts and template.
    """
    fails = named({
        "audit_gates": ~i["audited"], "journal_surface": ~i["surface"], "unresolved_review": i["unresolved"] > 0, "numeric_coverage": i["numeric"] < least["numeric"], "citation_registry": ~i["cited_all"],
        "rob_coverage": i["rob"] < least["rob"], "grade_coverage": i["grade"] < least["grade"], "tensions": i["tensions"] < least["tensions"], "receipts": i["receipts"] < least["receipts"], "template_language": i["template"],
    })
    return fails, named({"few_receipts": i["receipts"] < RECOMMENDED_SOURCES})


def audit_passed(artifact: Column) -> Column:
    """Whether an audit, as JSON text, says all-pass or counts as many passes as checks."""
    at = lambda *keys: F.coalesce(*[F.get_json_object(artifact, f"$.{k}") for k in keys])
    whole = lambda c: F.when(c.rlike(r"^-?[0-9]+$"), c.cast("long"))
    passed, total = whole(at("pass_count", "n_pass")), whole(at("total_count", "n_total"))
    counted = (total > 0) & (passed == total) & (F.coalesce(at("p1_pass"), F.lit("true")) == "true")
    return F.coalesce(at("all_pass") == "true", F.lit(False)) | F.coalesce(counted, F.lit(False))


def surface_passed(artifact: Column) -> Column:
    """Whether a surface report, as JSON text, says that it passed; an explicit flag decides before a verdict."""
    flag = F.coalesce(*[F.when(F.get_json_object(artifact, f"$.{k}").isin("true", "false"), F.get_json_object(artifact, f"$.{k}")) for k in ("pass", "passed")])
    said = F.lower(F.get_json_object(artifact, "$.verdict")).isin("pass", "passed", "ok", "clean")
    return F.coalesce(flag == "true", said, F.lit(False))


def unresolved_reviews(artifact: Column) -> Column:
    """Open P1 patches of a review, as JSON text; null where it states neither a count nor patches."""
    direct = F.get_json_object(artifact, "$.unresolved_p1_count")
    patches = F.from_json(F.get_json_object(artifact, "$.patches"), "array<struct<severity:string,status:string>>")
    open_ = F.filter(patches, lambda p: (F.upper(F.coalesce(p["severity"], F.lit(""))) == "P1") & ~F.lower(F.coalesce(p["status"], F.lit(""))).isin("applied", "resolved", "auto_strip"))
    return F.coalesce(F.when(direct.rlike("^[0-9]+$"), direct.cast("long")), F.when(patches.isNotNull(), F.size(open_).cast("long")))


def sufficiency_reasons(receipts: Column, tensions: Column, primary: Column) -> Column:
    """Why a corpus is thin; a negative count of primary sources is unknown."""
    return named({"n_receipts": receipts < THIN["n_receipts"], "n_tensions": tensions < THIN["n_tensions"], "n_primary_tier": (primary >= 0) & (primary < THIN["n_primary_tier"])})


def scope_reasons(receipts: Column, tensions: Column, classes: Column) -> Column:
    """Why a corpus is too broad for one synthesis."""
    return named({"n_receipts": receipts > BROAD["n_receipts"], "n_tensions": tensions > BROAD["n_tensions"], "n_outcome_classes": classes > BROAD["n_outcome_classes"]})


def review_type(declared: Column, receipts: Column, tensions: Column, primary: Column, classes: Column) -> Column:
    """The declared type where the corpus bears it, else a map, a brief or a thin brief."""
    return (
        F.when(F.size(scope_reasons(receipts, tensions, classes)) > 0, "evidence_map")
        .when(F.size(sufficiency_reasons(receipts, tensions, primary)) == 0, token(declared, REVIEW_TYPES, REVIEW_TYPES[0]))
        .when((receipts >= THIN["n_receipts"]) & (tensions >= THIN["n_tensions"]), "evidence_brief")
        .otherwise("thin_corpus_brief")
    )


def eligibility(verdict: Column, track: Column, level: Column, ready: Column) -> Column:
    """What a run may support in a field's synthesis."""
    return (
        F.when(F.coalesce(verdict != "AAA", F.lit(True)), "excluded").when(F.contains(track, F.lit("SCOP")), "scoped_support")
        .when((level >= 5) & ready, "full_aaa_primary").when(level >= 4, "analytical_support").otherwise("scoped_support")
    )


def surface_of(declared: Column) -> Column:
    """Where a review of a type is shown; an unknown type counts as compact."""
    kind = token(declared, REVIEW_TYPES, "")
    return F.when(kind == "", "research_synthesis").when(kind.isNull() | kind.isin(*COMPACT_TYPES), "internal_compact").otherwise("research_synthesis")


def _decision(state: str, blocker: Column | str | None, retryable: Column | bool, action: str) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(state).alias("state"), as_col(blocker).cast("string").alias("blocker"), as_col(retryable).alias("retryable"), F.lit(action).alias("action"))


def candidate_decision(declared: Column, evidence: dict[str, Column], least: dict[str, int]) -> Column:
    """struct(state, blocker, retryable, action) of a candidate: its first unmet floor, if any.

    evidence has manifest, density_ok, quant_claims, receipts, primary_tier, direct_receipts and precise.
    """
    e = evidence
    blocker = F.get(named({
        "latest_run_missing_manifest": ~e["manifest"], "prior_numeric_density_failed": ~e["density_ok"], **{f"{k}_below_floor": e[k] < n for k, n in least.items()}, "source_topic_precision_low": ~e["precise"],
    }), F.lit(0))
    return (
        F.when(surface_of(declared) == "internal_compact", _decision("internal_alpha", "public_research_surface_compact_review", True, "expand_corpus"))
        .when(blocker.isNotNull(), _decision("needs_corpus", blocker, True, "repair_corpus"))
        .otherwise(_decision("receipt_ready", None, False, "synthesize"))
    )


# Statuses and prefixes of statuses that decide.
SUBMITTABLE = ("eligible", "public_research_surface_ok")
OPERATIONAL = ("cycle_already_running", "remote_dedupe_failed", "submission_failed", "submit_not_configured")
TERMINAL = ("terminal_", "duplicate_", "retracted_", "rejected_")
CORPUS_STATUS = ("preflight_", "receipt_preflight_", "source_topic_precision_", "source_bundle_", "public_surface_direct_receipts_", "needs_corpus")


def status_decision(declared: Column, status: Column) -> Column:
    """struct(state, blocker, retryable, action) that a status stands for, the first that fits."""
    s = F.trim(F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown")))
    starts = lambda prefixes: s.rlike("^(" + "|".join(prefixes) + ")")
    return (
        F.when(s == "published", _decision("terminal", None, False, "none"))
        .when(s == "submitted", _decision("submitted_pending", None, True, "poll_decision"))
        .when(starts(OPERATIONAL), _decision("operational_error", s, True, "retry_operation"))
        .when(starts(TERMINAL), _decision("terminal", s, False, "stop"))
        .when(surface_of(declared) == "internal_compact", _decision("internal_alpha", "public_research_surface_compact_review", True, "expand_corpus"))
        .when(s.isin(*SUBMITTABLE), _decision("publishable", None, False, "submit"))
        .when(starts(CORPUS_STATUS), _decision("needs_corpus", s, True, "repair_corpus"))
        .otherwise(_decision("needs_revision", s, s != "unknown", "revise"))
    )


#: Words that claim a benefit, and digits, which an inference must not bring in.
_BENEFIT, _DIGIT = r"(?i)\b(benefits?|improves?|effective|protects?|extends?)\b", r"[0-9]"
_NO_SIGNAL = ("none", "none identified", "no human signal")


def validated(claims: DataFrame, receipts: DataFrame, canon: DataFrame) -> DataFrame:
    """(id, errors): what is wrong with inferences, from claims(id, claim, conservation, testability,
    confidence, tier, anchors, canon_refs, human) against receipts(id, effect) and canon(id).

    References are looked up by joins of exploded ids; a claim without errors has an empty array.
    """
    texts = ("claim", "conservation", "testability")
    kinds = {"anchors": "anchor", "canon_refs": "canon", "human": "human"}

    def named_refs(column: str, kind: str) -> Column:
        own = F.coalesce(F.col(column), F.array().cast("array<string>"))
        own = F.filter(own, lambda r: ~F.lower(r).isin(*_NO_SIGNAL)) if kind == "human" else own
        return F.transform(own, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))

    refs = F.concat(*[named_refs(c, k) for c, k in kinds.items()])
    known = receipts.select(F.lit("anchor").alias("kind"), F.col("id").alias("ref"), "effect").union(receipts.select(F.lit("human"), "id", "effect")).union(canon.select(F.lit("canon"), "id", F.lit(None).cast("string")))
    met = claims.select("id", F.explode(refs).alias("r")).select("id", "r.kind", "r.ref").join(known.withColumn("hit", F.lit(True)), ["kind", "ref"], "left")
    is_ = lambda k: F.col("kind") == k
    looked = met.groupBy("id").agg(
        *[F.bool_or(is_(k) & F.col("hit").isNull()).alias(f"lost_{k}") for k in kinds.values()], F.bool_or(is_("human")).alias("has_human"), F.bool_or(is_("anchor") & F.col("effect").isin("positive", "mixed")).alias("lifted")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    prose = F.concat_ws(" ", *texts)
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    errors = named({
        "tier": ~F.coalesce(F.col("tier"), F.lit("")).startswith("D1_"), "confidence": ~F.coalesce(F.col("confidence"), F.lit("")).isin("low", "medium", "high"), "text_missing": blank("claim") | blank("conservation") | blank("testability"),
        "no_anchor": none("anchors"), "unknown_anchor": yes("lost_anchor"), "no_canon": none("canon_refs"), "unknown_canon": yes("lost_canon"), "unknown_human_signal": yes("lost_human"),
        "high_without_human_signal": (F.col("confidence") == "high") & ~yes("has_human"), "benefit_without_positive_anchor": prose.rlike(_BENEFIT) & ~yes("lifted"), "new_number": prose.rlike(_DIGIT),
    })
    return claims.join(looked, "id", "left").select("id", errors.alias("errors"))
