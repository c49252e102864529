"""Queries of manuscripts held against their own sources and statistics; texts are fragments that say what the rules make of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import coherence
from weft.plans.artifacts import _picked
from weft.plans.outcomes import _values
from weft.plans.tables import registrar, table

QUERIES, SQL, query = registrar()


def _texts(spark, sf_dir, texts):
    return _picked(spark, sf_dir, [F.lit(t) for t in texts]).withColumnRenamed("x", "text")


#: (text, (claim, category) that receipts, all direct or review, contradict).
DENIED = [("There were no direct sources here.", [(0, "direct")]), ("No sources were classified primarily as review; no Review studies exist.", [(0, "review"), (1, "review")]), ("No animal studies were found.", []), ("Direct sources were found.", []), ("", [])]


@query("denied_sources", f"""with t(k, claim, category) as (values {_values([(i, *c) for i, (_, cs) in enumerate(DENIED) for c in cs])}),
    r as (select l_orderkey as id, case when l_linenumber % 2 = 0 then 'direct' else 'review' end as category, count(*) as n from lineitem group by all)
    select o_orderkey as id, claim, category, n from orders join t on k = o_orderkey % {len(DENIED)} join r on r.id = o_orderkey and r.category = t.category""".replace("category, n from orders", "t.category, n from orders"))
def denied_sources(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "Direct").otherwise("review")
    receipts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), kind.alias("directness"))
    return coherence.denied_sources(_texts(spark, sf_dir, [t for t, _ in DENIED]), receipts)


#: (text, incoherent sentences).
INCOHERENT = [
    ("A marginal signal was seen (p < 0.001). It held.", ["A marginal signal was seen (p < 0.001)."]), ("The effect was not significant (p = 0.03). The effect was not significant (p = 0.03).", ["The effect was not significant (p = 0.03)."]),
    ("A significant rise was seen (p = 0.01).", []), ("Plain.\n## References\nThe effect was not significant (p = 0.03).", []), ("", []),
]


@query("incoherent_sentences", f"with t(k, sentence) as (values {_values([(i, s) for i, (_, ss) in enumerate(INCOHERENT) for s in ss])}) select o_orderkey as id, sentence from orders join t on k = o_orderkey % {len(INCOHERENT)}")
def incoherent_sentences(spark, sf_dir):
    return coherence.incoherent_sentences(_texts(spark, sf_dir, [t for t, _ in INCOHERENT]))


#: (report, issues, leaks).
REPORTS = [('[{"issue_type": "broken_paper_id_citation", "id": "C1"}, {"id": "broken_paper_id-3"}, {"issue_type": "thin"}]', 3, 2), ('{"issues": [{"issue_type": "x"}]}', 1, 0), ('{"issues": []}', 0, 0), ("{}", 0, 0), ("", 0, 0), ("not JSON", 0, 0)]


@query("consistency_counts", f"with t(k, issues, leaks) as (values {_values([(i, *r[1:]) for i, r in enumerate(REPORTS)])}) select o_orderkey as id, issues, leaks from orders join t on k = o_orderkey % {len(REPORTS)}")
def consistency_counts(spark, sf_dir):
    return coherence.consistency_counts(_texts(spark, sf_dir, [r for r, *_ in REPORTS]).withColumnRenamed("text", "report"))


PHRASES = ["gate adjudication", "claim receipts", "gate-rejected"]
#: (text, phrases with their counts, where the writer did not run the gate).
METHODS = [
    ("## Methods\nGate adjudication and gate adjudication of claim receipts.\n## Results\ngate-rejected", [("gate adjudication", 2), ("claim receipts", 1)]), ("## Results\nclaim receipts", []), ("## Methods\nPlain.\n### What did NOT run\nGate adjudication.\n### Next\nGATE-rejected texts.", [("gate-rejected", 1)]), ("## Methods\nPlain.", []),
]


@query("stale_methods", f"with t(k, phrase, n) as (values {_values([(i, *p) for i, (_, ps) in enumerate(METHODS) for p in ps])}) select o_orderkey as id, phrase, n from orders join t on k = o_orderkey % {len(METHODS)} where o_orderkey % 3 > 0")
def stale_methods(spark, sf_dir):
    papers = _texts(spark, sf_dir, [t for t, _ in METHODS]).withColumn("writer_path", F.when(F.col("id") % 3 == 0, "x/GATE_writer").when(F.col("id") % 3 == 1, "x/paper_writer"))
    return coherence.stale_methods(papers, "gate", PHRASES)


#: (sentence, doubled subject, changed after all).
NUMERIC = [
    ("The drug group improved most for the drug group was best.", True, False), ("The drug group improved for the placebo group was worse.", False, False), ("There was no change in speed (0.13 m/s).", False, True), ("There was no significant change (p = 1) in speed (2 kg).", False, True),
    ("No change (95% CI 1 to 2 kg) was seen.", False, False), ("No change (0 points) was seen.", False, False), ("No change in class (3 of 4) was seen.", False, False), ("Change (3 kg).", False, False), ("", False, False),
]


@query("numeric_sentences", f"with t(k, doubled, changed) as (values {_values([(i, *r[1:]) for i, r in enumerate(NUMERIC)])}) select o_orderkey as id, doubled, changed from orders join t on k = o_orderkey % {len(NUMERIC)}")
def numeric_sentences(spark, sf_dir):
    s = _texts(spark, sf_dir, [t for t, *_ in NUMERIC])
    return s.select("id", coherence.doubled_subject(F.col("text")).alias("doubled"), coherence.changed_after_all(F.col("text")).alias("changed"))


@query("overclaim_issues", "select s_suppkey as id, 'outcome_direction_overclaim' as code, 'P1' as severity, s_name as evidence from supplier where s_acctbal > 0")
def overclaim_issues(spark, sf_dir):
    return coherence.as_issues(table(spark, sf_dir, "supplier").where("s_acctbal > 0"), "s_suppkey", "outcome_direction_overclaim", "P1", F.col("s_name"))
