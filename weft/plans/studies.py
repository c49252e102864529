"""Queries of study classification. Studies are derived from orders, so that titles and abstracts reach every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import studies
from weft.plans.tables import derived, derived_sql, registrar, table

QUERIES, SQL, query = registrar()


def _cases(key: str, texts: list[str]) -> str:
    return f"case {key} % {len(texts)} " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(texts)) + " end"


STUDY = {
    "title": _cases("o_orderkey", [
        "A randomized placebo-controlled trial of agent in older adults", "Systematic review of agent and aging", "Study protocol for a trial of agent", "Cohort study of agent and mortality in patients", "Agent extends lifespan in mice", "In vitro mechanism of agent signaling",
        "Design of the agent study", "Meta-analysis of agent in adults", "Agent in children", "A single-arm study of agent", "Notes on agent", "Quasi-randomised agent in humans", "Agent and physical performance in women", "Agent study design", "Longevity and agent in healthy humans: a randomized clinical trial",
    ]),
    "abstract": _cases("o_orderkey", [
        "Participants (n = 120) improved; p = 0.03.", "We will assess agent in adults.", "Mice were treated with agent.", "We randomized adults to agent or placebo; weight was reduced by 12%.", "Background: none. Methods: double-blind assignment. Results: hazard ratio 0.8.", "Open-label pilot; agent reduced fatigue.",
        "Completion is expected in 2027. Trials will evaluate agent.", "Randomized trials are needed to confirm effects.", "Transgenic mice and molecular mechanism of the pathway.", "Retrospective registry analysis in patients with diabetes.", "", "A meta-analysis of trials. Children were enrolled.", "The trial is designed to test agent in men and women.",
    ]),
    "source": "case when o_orderkey % 7 = 0 then 'clinicaltrials' else 'pubmed' end", "has_results": "o_orderkey % 3 = 0", "venue": _cases("o_orderkey", ["The Lancet", "Journal of Agents", "", "BMJ Open"]), "year": "1990 + o_orderkey % 36",
}
_S = f"s as {derived_sql('orders', STUDY, 'o_orderkey')}"


def rows(spark, sf_dir):
    return derived(table(spark, sf_dir, "orders"), STUDY, "o_orderkey")


def _c(*names):
    return [F.col(n) for n in names]


def _any(col: str, terms) -> str:
    return "(" + " or ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def _re(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{pattern}')"


_ROLES = f"""{_S}, l as (select *, lower(title || ' ' || abstract) as low, {_re('abstract', studies.REPORTED)} as reported from s),
    r as (select *, case when source = 'clinicaltrials' then case when has_results then 'published_results' else 'registered_pending' end when {_any('low', studies.REVIEW_MARKERS)} then 'review' when {_any('low', studies.PROTOCOL_MARKERS)} and not reported then 'published_protocol' when reported then 'published_results'
      when {_re('abstract', studies.TRIAL_DESIGN)} and {_re('abstract', studies.QUALITATIVE)} then 'published_results' else 'mechanistic' end as role from l),
    d as (select *, case role when 'published_results' then case when {_re('abstract', studies.RANDOMIZED)} then 'rct' else 'observational' end when 'review' then case when {_any('lower(abstract)', studies.META_MARKERS)} then 'meta_analysis' else 'review' end when 'published_protocol' then 'protocol' when 'registered_pending' then 'registry' else 'mechanistic' end as design from r),
    t as (select *, case when design in ('rct', 'meta_analysis') then case when {_any('lower(venue)', studies.HIGH_IMPACT)} then 'A1' else 'A2' end when role in ('published_results', 'review') then 'A2' when role in ('published_protocol', 'registered_pending') then 'B' else 'C' end as tier,
      not (not {_re('abstract', studies.HUMAN_TRIAL)} and ({_re('abstract', studies.ANIMAL)} or {_re('abstract', studies.CELL)})) and not {_re('abstract', studies.PEDIATRIC)} and {_re('low', chr(92) + 'b(?:agent)' + chr(92) + 'b')} and {_re('title', studies.AGING_TITLE)} as direct from d)"""


def told(spark, sf_dir):
    s = rows(spark, sf_dir)
    s = s.withColumn("role", studies.study_role(*_c("source", "title", "abstract", "has_results")))
    s = s.withColumn("design", studies.study_design(*_c("role", "abstract")))
    return s.withColumn("tier", studies.evidence_tier(*_c("role", "design", "venue"))).withColumn("direct", studies.is_direct(*_c("title", "abstract"), "aging in older adults", ["agent"]))


@query("role_design_tier", f"with {_ROLES} select o_orderkey, role, design, tier from t")
def role_design_tier(spark, sf_dir):
    return told(spark, sf_dir).select("o_orderkey", "role", "design", "tier")


@query("direct_strict", f"with {_ROLES} select o_orderkey, direct, direct and year >= 2005 as strict, case when role in ('published_results', 'review') then 'not assessed' when role in ('registered_pending', 'published_protocol') then 'n/a (no results)' else 'n/a (preclinical)' end as bias from t")
def direct_strict(spark, sf_dir):
    return told(spark, sf_dir).select("o_orderkey", "direct", studies.is_strict(*_c("direct", "year"), 2005).alias("strict"), studies.bias_label(F.col("role")).alias("bias"))


@query("confidence_verdict", f"""with {_ROLES}, g as (select o_orderkey % 997 as topic, count(*) filter (where direct and role = 'published_results' and design = 'rct' and tier in ('A1', 'A2')) as trials, count(*) filter (where direct and role = 'review' and design = 'meta_analysis') as meta,
      count(*) filter (where direct and role = 'published_results') as results, count(*) filter (where direct and role in ('registered_pending', 'published_protocol')) as pending from t group by 1)
    select *, case when trials > 0 or meta > 0 then 'moderate' when results > 0 then 'low' when pending > 0 then 'low' else 'very low' end as verdict from g""")
def confidence_verdict(spark, sf_dir):
    return studies.confidence(told(spark, sf_dir).withColumn("topic", F.col("o_orderkey") % 997), "topic")


META = {
    "design": _cases("o_orderkey", ["Phase 3 randomized controlled trial", "Randomised, double-blind", "Systematic review of randomized trials", "Study protocol: randomized", "prospective cohort study", "single-arm study", "in vitro cell culture", "Editorial", "", "observational randomized", "target trial emulation"]),
    "species": _cases("o_orderkey", ["Human", "mouse", "", "older adults", "plant", "C. elegans", "patients"]),
    "endpoint": _cases("o_orderkey", ["mortality", "mechanistic", "", "surrogate", "odd"]),
}
_CLASS = f"""case when kind = 'protocol' then 'D1/protocol' when kind = 'rct' and human then case when ep = 'mechanistic' then 'A2/indirect' else 'A1/direct' end when kind = 'review' then 'B1/review' when kind = 'observational' and human then 'B2/indirect' when kind = 'preclinical' or animal then 'C1/mechanistic'
    when kind = 'unknown' and sp = '' then 'unknown/unknown' when kind = 'unknown' and not human and not animal then 'C2/review' else 'unknown/unknown' end"""


def _classes(design: str, species: str, endpoint: str, source: str) -> str:
    """CTEs that classify columns of a source; the last is named x and has `says`."""
    return f"""k as (select *, lower(trim(coalesce({design}, ''))) as de, lower(trim(coalesce({species}, ''))) as sp, lower(trim(coalesce({endpoint}, ''))) as ep from {source}),
    k2 as (select *, case when {_any('de', studies.PROTOCOL_DESIGNS)} then 'protocol' when {_any('de', studies.REVIEW_DESIGNS)} then 'review' when {_re('de', studies.NOT_RANDOMIZED)} then 'observational' when {_any('de', studies.RCT_DESIGNS)} then 'rct' when {_any('de', studies.OBSERVED_DESIGNS)} then 'observational' when {_any('de', studies.PRECLINICAL_DESIGNS)} then 'preclinical' else 'unknown' end as kind,
      {_any('sp', studies.HUMAN_WORDS)} as human, {_any('sp', studies.ANIMAL_WORDS)} as animal from k),
    x as (select *, {_CLASS} as says from k2)"""


@query("evidence_taxonomy", f"with m as {derived_sql('orders', META, 'o_orderkey')}, {_classes('design', 'species', 'endpoint', 'm')} select o_orderkey, kind as design_class, split_part(says, '/', 1) as tier, split_part(says, '/', 2) as directness from x")
def evidence_taxonomy(spark, sf_dir):
    m = derived(table(spark, sf_dir, "orders"), META, "o_orderkey")
    return studies.with_class(m, *_c("design", "species", "endpoint")).select("o_orderkey", "design_class", "c.tier", "c.directness")


_PROTO = f"""({_re('title', studies.TITLE_PROTOCOL)} or (regexp_matches(title, '(?i)\\bstudy design\\s*$') and regexp_matches(abstract, '(?i)\\b(trial|study) is designed to\\b')) or (regexp_matches(title, '(?i)\\bdesign of\\b[^.!?]*\\b(trials?|studies|study)\\b')
    and regexp_matches(abstract, '(?i)\\b(completion\\b[^.!?]{{0,70}}\\bexpected|trials? will (provide|evaluate)|anticipated [0-9]+ (patients|participants))\\b')) or regexp_matches(abstract, '(?i)\\b(results?|findings) (from|of) this protocol (are|is) expected\\b'))"""
_METHODS = "(?is)\\bmethods?\\s*:\\s*(.*?)(?:\\b(?:results?|conclusions?|discussion)\\s*:|$)"
_PRIMARY = f"""{_S}, q as (select *, {_PROTO} as proto, case when regexp_matches(abstract, '{_METHODS}') then regexp_extract(abstract, '{_METHODS}', 1) else abstract end as own from s),
    q2 as (select *, array_to_string(list_filter(string_split_regex(own, '[.!?]\\s+'), lambda z: not {_re('z', studies.FUTURE_TRIAL)} and not {_re('z', studies.NOT_RANDOMIZED)}), ' ') as tells from q),
    p as (select *, not proto and not {_re('title', studies.TITLE_REVIEW)} and not {_re('title', studies.NOT_RANDOMIZED)} and ({_re('title', studies.TITLE_RCT)} or ({_re('tells', studies.TITLE_RCT)} and not {_re('abstract', studies.TITLE_REVIEW)})) as is_primary, title || ' ' || abstract as said from q2),
    i as (select *, case when proto then 'study protocol' when {_re('said', studies.TITLE_REVIEW)} then 'systematic review' when is_primary then 'randomized controlled trial' when {_re('said', studies.TITLE_OBSERVED)} then 'cohort' when {_re('said', studies.TITLE_PRECLINICAL)} then 'preclinical' else '' end as t_design,
      case when {_re('said', studies.TITLE_ANIMAL)} then 'mouse' when {_re('said', studies.TITLE_HUMAN)} then 'human' else '' end as t_species, case """ + " ".join(f"when {_re('said', p)} then '{k}'" for k, p in studies.ENDPOINT_KINDS.items()) + " else '' end as t_endpoint from p)"


@query("primary_trials", f"with {_PRIMARY} select o_orderkey, proto as protocol, is_primary as primary_trial from p")
def primary_trials(spark, sf_dir):
    return studies.with_trial(rows(spark, sf_dir), *_c("title", "abstract")).select("o_orderkey", "protocol", "primary_trial")


@query("taxonomy_inferred", f"with {_PRIMARY}, {_classes('t_design', 't_species', 't_endpoint', 'i')} select o_orderkey, split_part(says, '/', 1) as tier, split_part(says, '/', 2) as directness from x")
def taxonomy_inferred(spark, sf_dir):
    return studies.with_inferred(rows(spark, sf_dir), *_c("title", "abstract")).select("o_orderkey", "c.*")


@query("paper_tier", f"""with {_PRIMARY}, e as (select i.*, {META['design'].replace('o_orderkey % 11', '(o_orderkey // 13) % 11')} as m_design, case when o_orderkey % 2 = 0 then '' else 'human' end as m_species from i where true),
    {_classes('m_design', 'm_species', "''", 'e')}, y as (select o_orderkey as ok, says as stated from x), {_classes('t_design', 't_species', 't_endpoint', 'e').replace('k as', 'ka as').replace('from k)', 'from ka)').replace('k2 as', 'kb as').replace('from k2)', 'from kb)').replace('x as', 'xa as')},
    z as (select xa.*, case when m_design = '' and m_species = '' then says else stated end as found, not proto and not regexp_matches(m_design, '{studies.TITLE_PROTOCOL}') and not {_re("title || ' ' || m_design", studies.TITLE_REVIEW)} and not {_re("title || ' ' || m_design", studies.NOT_RANDOMIZED)}
      and ({_re("title || ' ' || m_design", studies.TITLE_RCT)} or ({_re('tells', studies.TITLE_RCT)} and not {_re('abstract', studies.TITLE_REVIEW)})) as own_trial from xa join y on ok = o_orderkey),
    w as (select o_orderkey, case when says = 'D1/protocol' then says when own_trial then 'A1/direct' when found not like 'unknown%' then found when o_orderkey % 10 = 0 then 'A1/direct' else 'B2/indirect' end as v from z)
    select o_orderkey, split_part(v, '/', 1) as tier, split_part(v, '/', 2) as directness from w""")
def paper_tier(spark, sf_dir):
    s = rows(spark, sf_dir).withColumn("m_design", F.expr(META["design"].replace("o_orderkey % 11", "(o_orderkey div 13) % 11"))).withColumn("m_species", F.expr("case when o_orderkey % 2 = 0 then '' else 'human' end"))
    return studies.with_paper_tier(s, *_c("title", "abstract", "m_design", "m_species"), F.lit(""), F.col("o_orderkey") % 10 == 0).select("o_orderkey", "c.*")


@query("population_of", f"""with {_S}, b as (select o_orderkey, lower(title || ' ' || abstract) as x from s) select o_orderkey, case when {_re('x', studies.HUMAN_TEXT)} then 'human' when {_re('x', studies.ANIMAL_TEXT)} then 'animal' else 'unknown' end as population from b""")
def population_of(spark, sf_dir):
    return rows(spark, sf_dir).select("o_orderkey", studies.population(F.concat_ws(" ", "title", "abstract")).alias("population"))


LANE = {
    "tier": _cases("o_orderkey", ["A1", "A2", "B1", "B2", "C", "D1", "a1"]), "directness": _cases("o_orderkey", ["direct", "review", "mechanistic", "indirect", "Direct"]), "venue": "case when o_orderkey % 9 = 0 then 'Veterinary Record' else 'Journal of Agents' end",
    "people": _cases("o_orderkey", ["older adults", "", "broiler chickens", "adults"]), "excerpt": _cases("o_orderkey", ["in aged mice", "", "in participants"]), "title": STUDY["title"],
}


@query("evidence_lane", f"""with v as (select *, concat_ws(' ', nullif(title, ''), nullif(venue, ''), nullif(people, '')) as idt, upper(tier) as ti, lower(directness) as di from {derived_sql('orders', LANE, 'o_orderkey')}),
    w as (select *, {_re('idt', studies.ANIMAL_PAPER)} as animal, {_re('excerpt', studies.ANIMAL_PAPER)} as said, {_re('idt', studies.HUMAN_IDENTITY)} and ({_re('idt', studies.HUMAN_TRIAL)} or {_re('idt', studies.TRIAL_IDENTITY)} or {_re('title', studies.IN_HUMANS)}) as human from v),
    z as (select *, case when di = 'review' or ti = 'B1' then 'review_meta_analysis' when ti = 'A1' and not animal and (not said or human) then 'human_rct' when animal or (said and not human) then 'animal_preclinical' when di = 'mechanistic' then 'human_mechanistic' when ti in ('A2', 'B2') then 'human_observational' when ti = 'C' then 'animal_preclinical' else 'background_only' end as lane from w)
    select o_orderkey, lane, case when di = 'direct' and lane = 'animal_preclinical' then 'indirect' else di end as effective_directness from z""")
def evidence_lane(spark, sf_dir):
    v = derived(table(spark, sf_dir, "orders"), LANE, "o_orderkey").withColumn("lane", studies.lane(*_c("tier", "directness", "title", "venue", "people", "excerpt")))
    return v.select("o_orderkey", "lane", studies.effective_directness(*_c("directness", "lane")).alias("effective_directness"))


OUTCOME = {
    "endpoint": _cases("o_orderkey", ["Quality of  life", "SF-36", "vital capacity", "HbA1c", "pain score", "general health index", "", "Vitality", "emotional wellbeing scale", "Psychological well being", "self reported pain", "vitality scale", "patient-reported outcome", "maximum oxygen uptake"]), "current_class": _cases("o_orderkey", ["other", "immune", "Mortality and Survival Outcomes", "contextual_other", "dosing_pharmacokinetics", "Frailty", "bad class!", ""]),
    "source_text": _cases("o_orderkey", ["Blood pressure in adults", "kidney function", "Dose of agent", "cytokine response", "grip strength", "sarcopenia and muscle", "vitamin deficiency", "all-cause mortality", "bone fracture"]), "directness": _cases("o_orderkey", ["direct", "mechanistic", "Protocol", "review"]),
}
_KEY = "regexp_replace(array_to_string(list_filter(regexp_extract_all(lower(current_class), '[a-z0-9]+'), lambda w: w <> 'and'), '_'), '(_?(outcomes?|endpoints?))+$', '')"
_REMAP = " ".join([
    *[f"when ep in ({', '.join(repr(n) for n in names)}) then '{k}'" for k, names in studies.ENDPOINT_NAMES.items()],
    *[f"when {_re('ep', p)} then '{k}'" for p, k in studies.ENDPOINT_PATTERNS],
])


@query("outcome_refined", f"""with o as (select *, regexp_replace(lower(trim(endpoint)), '\\s+', ' ', 'g') as ep, regexp_replace(lower(trim(source_text)), '\\s+', ' ', 'g') as low, {_KEY} as k0 from {derived_sql('orders', OUTCOME, 'o_orderkey')}), k as (select *, case k0 when 'immune' then 'immune_inflammation' else k0 end as key from o),
    n as (select *, case when {_re('low', studies.SOURCE_CLASS['cardiometabolic'])} then 'cardiometabolic' when {_re('low', studies.SOURCE_CLASS['safety_comorbidity'])} then 'safety_comorbidity' end as named from k)
    select o_orderkey, case {_REMAP} else current_class end as remapped,
      case when lower(directness) = 'protocol' and key = 'contextual_other' then 'contextual_other' when named is not null and current_class in ('other', 'contextual_other', 'skeletal_fracture_bone', 'dosing_pharmacokinetics') then named when current_class <> 'other' then key """ + " ".join(f"when {_any('low', t)} then '{k}'" for k, t in studies.OTHER_CLASS.items()) + """ when lower(directness) = 'mechanistic' then 'mechanism' else 'contextual_other' end as refined,
      case when regexp_matches(regexp_replace(lower(trim(current_class)), '[- ]', '_', 'g'), '^[a-z][a-z0-9_]*$') then regexp_replace(lower(trim(current_class)), '[- ]', '_', 'g') end as token from n""")
def outcome_refined(spark, sf_dir):
    o = derived(table(spark, sf_dir, "orders"), OUTCOME, "o_orderkey")
    return o.select("o_orderkey", studies.remapped_outcome(*_c("endpoint", "current_class")).alias("remapped"), studies.refined_outcome(*_c("current_class", "source_text", "directness")).alias("refined"), studies.outcome_token(F.col("current_class")).alias("token"))


@query("outcome_labels", f"""with o as (select o_custkey, o_orderkey, {OUTCOME['current_class']} as current_class from orders), k as (select *, {_KEY} as k0 from o), f as (select o_custkey, case k0 when 'immune' then 'immune_inflammation' else k0 end as key, min(o_orderkey) as f, arg_min(current_class, o_orderkey) as label from k group by all)
    select o_custkey, string_agg(label, '|' order by f) as labels from f group by o_custkey""")
def outcome_labels(spark, sf_dir):
    o = derived(table(spark, sf_dir, "orders"), {"label": OUTCOME["current_class"]}, "o_custkey", "o_orderkey")
    return studies.distinct_labels(o, "o_custkey", "o_orderkey", "label").select("o_custkey", F.array_join("labels", "|").alias("labels"))


SCREEN = {"tier": _cases("o_orderkey", ["A1", "a2", "B1", "B", "C2", "odd", "Mixed", ""]), "directness": _cases("o_orderkey", ["direct", "mechanistic", "review", "preclinical", "strange"]), "design": _cases("o_orderkey", ["", "RCT", "randomized trial", "cohort"]), "hint": _cases("o_orderkey", ["", "", "Low risk", "serious", "moderate", "??"])}


@query("bias_screen", f"""with s as (select o_orderkey, lower(directness) as di, lower(design) as de, lower(hint) as hi, case when lower(tier) = 'mixed' then 'mixed' else upper(tier) end as ti from {derived_sql('orders', SCREEN, 'o_orderkey')}),
    h as (select *, case when hi = 'low risk' then 'low' when hi = 'serious' then 'high' when hi = 'moderate' then 'some_concerns' end as hinted, contains(de, 'rct') or contains(de, 'randomized') or ti = 'A1' as rnd from s)
    select o_orderkey, case when ti not in ('A1', 'A2', 'B', 'B1', 'B2', 'C', 'C1', 'C2', 'mixed') or di = 'strange' then 'high' when hinted is not null then hinted when rnd and di in ('mechanistic', 'preclinical') then 'some_concerns' when rnd then 'low' when ti in ('A2', 'B1', 'B') or di = 'review' then 'some_concerns' else 'high' end as overall,
      case when ti not in ('A1', 'A2', 'B', 'B1', 'B2', 'C', 'C1', 'C2', 'mixed') or di = 'strange' then 'missing_or_invalid_tier_or_directness' when hinted is not null then 'explicit_metadata_hint:' || hinted when rnd and di in ('mechanistic', 'preclinical') then 'randomized_or_top_tier_default,mechanistic_preclinical_bias_floor' when rnd then 'randomized_or_top_tier_default' when ti in ('A2', 'B1', 'B') or di = 'review' then 'nonrandomized_or_secondary_evidence_default' else 'low_tier_default' end as basis,
      ti not in ('A1', 'A2', 'B', 'B1', 'B2', 'C', 'C1', 'C2', 'mixed') or di = 'strange' as fail_closed from h""")
def bias_screen(spark, sf_dir):
    s = derived(table(spark, sf_dir, "orders"), SCREEN, "o_orderkey")
    return s.select("o_orderkey", studies.bias_screen(*_c("tier", "directness", "design", "hint")).alias("b")).select("o_orderkey", "b.*")


TOLD = {
    "thesis": _cases("o_orderkey", ["Agent improved gait", "Agent did not improve gait", "Agent blunted adaptation", "Similar overall risk", "Lower stroke mortality in NCT01234567", "No words at all", "ISRCTN778 found worse pain", "Postmenopausal women aged 50-65", "reduced muscle adaptation"]),
    "reference": _cases("o_orderkey", ["see nct00000001 in type 2 diabetes", "older adults", ""]), "p": _cases("o_orderkey", ["p=0.07", "P < 0.01", "p > 0.5", "", "p=.04"]), "outcome": "case when o_orderkey % 10 = 0 then 'mechanism' else 'frailty' end", "directness": "case when o_orderkey % 4 = 3 then 'indirect' else 'direct' end",
}


@query("text_direction", f"""with t as (select *, lower(thesis) as low, regexp_extract(p, '(?i)\\bp\\s*([=<>])\\s*0?\\.([0-9]+)', 1) as op, try_cast('0.' || regexp_extract(p, '(?i)\\bp\\s*([=<>])\\s*0?\\.([0-9]+)', 2) as double) as pv from {derived_sql('orders', TOLD, 'o_orderkey')})
    select o_orderkey, case when outcome = 'mechanism' then 'unclear' """ + " ".join(f"when {_re('low', '|'.join(v))} then '{k}'" for k, v in studies.DIRECTION_PHRASES.items()) + """ when op in ('=', '>') and pv >= 0.05 then 'null' else 'unclear' end as direction,
      upper(coalesce(nullif(regexp_extract(thesis, '(?i)NCT[0-9]{8}'), ''), nullif(regexp_extract(thesis, '(?i)ISRCTN[0-9]+'), ''), nullif(regexp_extract(reference, '(?i)NCT[0-9]{8}'), ''))) as trial,
      case when directness = 'direct' then coalesce(nullif(regexp_extract(thesis, '(?i)aged\\s+[0-9]+\\s*[-–to]\\s*[0-9]+'), ''), nullif(regexp_extract(thesis, '(?i)postmenopausal'), ''), nullif(regexp_extract(reference, '(?i)(older|elderly)\\s+adults?'), ''), nullif(regexp_extract(reference, '(?i)(type 2|t2d|t2dm)'), ''), '') else '' end as people from t""")
def text_direction(spark, sf_dir):
    t = derived(table(spark, sf_dir, "orders"), TOLD, "o_orderkey")
    return t.select("o_orderkey", studies.text_direction(*_c("thesis", "outcome", "p")).alias("direction"), studies.trial_id(*_c("thesis", "reference")).alias("trial"), studies.population_phrase(*_c("directness", "thesis", "reference")).alias("people"))
