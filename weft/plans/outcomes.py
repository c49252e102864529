"""Queries of result sentences and outcome claims.

Papers are put together from fragments by each order's key. A fragment states what the
rules make of it; the SQL lists that, so that it shares no pattern with the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import outcomes
from weft.plans.studies import _cases
from weft.plans.tables import derived, derived_sql, registrar, table

QUERIES, SQL, query = registrar()

ENDPOINTS = [("grip strength", r"\bgrip strength\b"), ("lean mass", r"\blean (?:body )?mass\b"), ("hba1c", r"\bhba1c\b"), ("pain", r"\bpain\b")]
DIRECTIONS = [("no_change", r"\b(?:did not (?:change|improve|differ)|no effect on|unchanged)\b"), ("increase", r"\b(?:increased|improved|rose|gained)\b"), ("decrease", r"\b(?:decreased|reduced|declined|fell)\b")]
#: (sentence, numeric, clauses): an own result sentence, whether it has a number, and (clause, endpoint, direction, comparator, p) of what it states.
STATED = [
    ("Grip strength increased by 5% in the drug group.", True, [("Grip strength increased by 5% in the drug group.", "grip strength", "increase", None, None)]),
    ("Lean body mass was reduced more than placebo (p = 0.03).", True, [("Lean body mass was reduced more than placebo (p = 0.03).", "lean mass", "decrease", "=", 0.03)]),
    ("HbA1c improved but pain did not change in the drug group.", False, [("HbA1c improved", "hba1c", "increase", None, None), ("pain did not change in the drug group.", "pain", "no_change", None, None)]),
    ("Grip strength and lean mass increased after 12 weeks (p < 0.01).", True, []),
    ("Pain did not improve versus usual care (p ≥ 0.2) in the treatment arm.", False, [("Pain did not improve versus usual care (p ≥ 0.2) in the treatment arm.", "pain", "no_change", ">=", 0.2)]),
    ("Lean mass may have increased in the treatment arm.", False, []),
    ("Grip strength improved and decreased pain was reported by most.", False, [("Grip strength improved", "grip strength", "increase", None, None), ("decreased pain was reported by most.", "pain", "decrease", None, None)]),
    ("Hand force (grip strength), a summary score, increased in the drug group.", False, [("Hand force (grip strength), a summary score, increased in the drug group.", "grip strength", "increase", None, None)]),
    ("Pain declined, e.g. at night vs. Day care, p: .04.", False, [("Pain declined, e.g. at night vs. Day care, p: .04.", "pain", "decrease", "=", 0.04)]),
    ("Grip strength (GS) improved in the drug group; GS rose again.", False, [
        ("Grip strength (grip strength) improved in the drug group", "grip strength", "increase", None, None), ("grip strength rose again.", "grip strength", "increase", None, None)]),
    ("Lean mass increased (p < 0.01, p = 0.2) in the treatment arm.", True, []),
    ("Pain fell and pain was reduced (p = 0.04) at the end.", True, []),
]
#: Sentences that give nothing: others' findings, background, too short, no effect.
SILENT = ["Previous studies improved pain.", "Pain improved [3, 4] elsewhere.", "No evidence that pain improved was seen.", "Pain improved.", "We asked 40 adults at home.", "The prevalence of pain increased by 3%."]
_N = len(STATED)
#: Abstract and results have a stated and a silent sentence each; what the introduction and the references say counts for nothing.
PAPER = {
    "abstract": f"concat({_cases('o_orderkey', [s for s, *_ in STATED])}, ' ', {_cases('o_custkey', SILENT)})",
    "results": f"concat({_cases('o_custkey', SILENT)}, ' <b>', {_cases('cast(floor(o_orderkey / 7) as bigint)', [s for s, *_ in STATED])}, '</b>')",
    "introduction": "'Pain was reduced by 5% in the drug group.'", "references": "'Pain was reduced by 7% in the drug group.'",
}


def papers(spark, sf_dir):
    rows = derived(table(spark, sf_dir, "orders"), PAPER, "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("paper"), F.inline(F.array(*[F.struct(F.lit(k).alias("section"), F.col(k).alias("text")) for k in PAPER])))


def _values(rows: list[tuple]) -> str:
    show = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()
    return ", ".join(f"({', '.join(map(show, r))})" for r in rows)


_STATED = f"""
    stated(k, sentence, has_number) as (values {_values([(i, s, n) for i, (s, n, _) in enumerate(STATED)])}),
    told as (select o_orderkey as paper, 1 as rank, 'abstract' as section, stated.* from orders join stated on k = o_orderkey % {_N}
             union all select o_orderkey, 2, 'results', stated.* from orders join stated on k = cast(floor(o_orderkey / 7) as bigint) % {_N})"""


@query("result_excerpts", f"with {_STATED} select paper, arg_min(section, rank) as section, sentence as excerpt from told where has_number group by paper, sentence")
def result_excerpts(spark, sf_dir):
    return outcomes.excerpts(papers(spark, sf_dir))


@query("result_context", f"with {_STATED} select paper, arg_min(section, rank) as section, sentence as excerpt from told group by paper, sentence")
def result_context(spark, sf_dir):
    """One stated sentence a section, so that the context is that sentence."""
    return outcomes.excerpts(papers(spark, sf_dir), numeric=False, context=True)


@query("outcome_claims", f"""
    with {_STATED}, clauses(k, clause, endpoint, direction, comparator, p) as (values {_values([(i, *c) for i, (*_, cs) in enumerate(STATED) for c in cs])}),
    once as (select paper, k, arg_min(section, rank) as section, sentence from told group by paper, k, sentence)
    select paper, section, clause, endpoint, direction, comparator, cast(p as double) as p, sentence as source_sentence from once join clauses using (k)""")
def outcome_claims(spark, sf_dir):
    return outcomes.outcome_claims(papers(spark, sf_dir), ENDPOINTS, DIRECTIONS)


#: Sentences that claims quote, and what becomes of them.
QUOTED = [*[(s, "kept") for s, *_ in STATED], *[(s, "drop_surface_gate" if len(s) < outcomes.QUOTE else "drop_unowned_result") for s in SILENT[:4]], ("Grip strength increased by 5% in", "drop_surface_gate"), ("", "drop_surface_gate")]
CLAIM = {"quote": f"replace({_cases('l_partkey', [q for q, _ in QUOTED])}, '  ', ' ')", "citation": _cases("l_suppkey", ["Smith 2020", " ", "Lee 2021"])}


def quoted(spark, sf_dir):
    """Line items as claims; a supplier is a paper, and every paper holds all sentences."""
    rows = derived(table(spark, sf_dir, "lineitem"), CLAIM, "l_orderkey", "l_linenumber", "l_suppkey", "l_tax", "l_discount")
    flags = {"admissible": F.col("l_tax") > 0.01, "on_topic": F.col("l_discount") > 0.01, "meaningful": F.col("l_linenumber") > 1}
    claims = rows.select(F.col("l_suppkey").alias("paper"), "l_orderkey", "l_linenumber", F.col("quote").alias("sentence"), "citation", *[c.alias(n) for n, c in flags.items()])
    whole = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("paper"), F.lit("results").alias("section"), F.lit(" ".join([s for s, *_ in STATED] + SILENT)).alias("text"))
    return outcomes.source_verdict(claims, whole)


_QUOTED = f"""quotes(k, verdict) as (values {_values([(i, v) for i, (_, v) in enumerate(QUOTED)])}),
    c as (select lineitem.*, verdict, {CLAIM['citation']} as citation from lineitem join quotes on k = l_partkey % {len(QUOTED)})"""


@query("source_verdicts", f"with {_QUOTED} select l_orderkey, l_linenumber, verdict from c")
def source_verdicts(spark, sf_dir):
    return quoted(spark, sf_dir).select("l_orderkey", "l_linenumber", "verdict")


@query("results_diagnostic", f"""
    with {_QUOTED}, g as (select *, verdict = 'kept' and l_tax > 0.01 as able, l_discount > 0.01 as topical, trim(citation) <> '' as cited from c)
    select l_suppkey as paper, count(*) as n_total_claims, count(*) filter (where verdict = 'drop_surface_gate') as drop_surface_gate, count(*) filter (where verdict = 'drop_unowned_result') as drop_unowned_result,
           count(*) filter (where able) as n_admissible, count(*) filter (where able and not topical) as drop_off_topic_arm, count(*) filter (where able and topical) as n_topic_matched,
           count(*) filter (where able and topical and not cited) as drop_missing_canonical_citation, count(*) filter (where able and topical and cited and l_linenumber > 1) as n_meaningful
    from g group by l_suppkey""")
def results_diagnostic(spark, sf_dir):
    return outcomes.results_diagnostic(quoted(spark, sf_dir), ["paper"])
