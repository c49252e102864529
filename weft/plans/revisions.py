"""Queries of the revision contract, pack floors, and of manuscript rules each of which fires."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import issues, revision, verdicts
from weft.plans.artifacts import _picked
from weft.plans.outcomes import _values
from weft.plans.tables import registrar, table

QUERIES, SQL, query = registrar()

#: (asks, their compact ASCII JSON).
ASKS = [(["Narrow the title", "Add é"], '["Narrow the title","Add \\u00e9"]'), ([], "[]"), (['Say "so"', "a\\b\nc"], '["Say \\"so\\"","a\\\\b\\nc"]'), (["𝛼 and β"], '["\\ud835\\udefc and \\u03b2"]')]


def _strings(x):
    return F.array(*map(F.lit, x)).cast("array<string>")


@query("ask_fingerprints", f"with t(k, j) as (values {_values([(i, j) for i, (_, j) in enumerate(ASKS)])}) select o_orderkey as id, sha256(j) as fingerprint from orders join t on k = o_orderkey % {len(ASKS)}")
def ask_fingerprints(spark, sf_dir):
    return _picked(spark, sf_dir, [_strings(a) for a, _ in ASKS]).select("id", revision.ask_fingerprint(F.col("x")).alias("fingerprint"))


#: (required, feedback, retry_unchanged, no request), what is asked, whether coverage is needed.
REQUESTS = [
    ((["a ", " ", "b"], "text", None, False), "a; b", True), (([" "], "text", None, False), "text", True), ((None, None, True, False), "", False), ((None, " ", None, False), " ", True), ((None, None, None, True), "", True), ((["a"], None, True, False), "a", True),
]


@query("revision_requests", f"with t(k, asked, needed) as (values {_values([(i, a, n) for i, (_, a, n) in enumerate(REQUESTS)])}) select o_orderkey as id, asked, needed from orders join t on k = o_orderkey % {len(REQUESTS)}")
def revision_requests(spark, sf_dir):
    one = [F.when(F.lit(not none), F.struct((_strings(r) if r is not None else F.lit(None).cast("array<string>")).alias("required_revisions"), F.lit(f).cast("string").alias("feedback"), F.lit(u).cast("boolean").alias("retry_unchanged"))) for (r, f, u, none), *_ in REQUESTS]
    return _picked(spark, sf_dir, one).select("id", revision.feedback(F.col("x")).alias("asked"), revision.needs_coverage(F.col("x")).alias("needed"))


@query("revision_gates", """
    select o_orderkey as id, case when k % 5 > 0 and k % 6 > 0 and k % 7 > 0 and k % 8 > 0 and k % 9 > 0 then k % 2 = 0 and k % 3 = 0 end as passed,
           case when k % 5 > 0 and k % 6 > 0 and k % 7 > 0 and k % 8 > 0 and k % 9 > 0 then concat_ws(',', case when k % 3 > 0 then 'a' end, case when k % 2 > 0 then 'b' end) end as unmet
    from (select *, o_orderkey as k from orders)""")
def revision_gates(spark, sf_dir):
    """Earlier gates left `a` unmet for two of three, `b` is unmet now for every other; some are of other asks, contexts or counts, or without paper or feedback."""
    k = F.col("o_orderkey")
    asks, before = _strings(["a", "b"]), F.when(k % 3 > 0, _strings(["a"])).otherwise(_strings([]))
    request = F.struct(F.lit(None).cast("array<string>").alias("required_revisions"), F.when(k % 5 > 0, "mend").alias("feedback"), F.lit(None).cast("boolean").alias("retry_unchanged"))
    previous = F.struct(
        (F.size(before) == 0).alias("passed"), F.when(k % 6 > 0, 2).otherwise(3).alias("ask_count"), before.alias("unmet_asks"), F.when(k % 7 > 0, revision.ask_fingerprint(asks)).otherwise("x").alias("ask_fingerprint"), F.when(k % 8 > 0, "c").otherwise("d").alias("context_fingerprint"),
    )
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), request.alias("request"), asks.alias("asks"), (k % 9 > 0).alias("has_paper"), F.when(k % 2 > 0, _strings(["b"])).otherwise(_strings([])).alias("unmet"), F.lit("c").alias("context"), previous.alias("previous"))
    return revision.gate_report(rows).select("id", "report.passed", F.array_join("report.unmet_asks", ",").alias("unmet"))


@query("sources_intact", """
    with r as (select l_orderkey as id, case when l_linenumber = 7 then '' else l_linenumber || '-' || l_partkey end as rid, l_suppkey % 25 as s, l_partkey % 20 as p from lineitem)
    select id, bool_and(s > 0 and p > 0 and rid <> '') and count(distinct rid) = count(*) as intact from r group by id""")
def sources_intact(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat_ws("-", "l_linenumber", "l_partkey")).alias("receipt_id"), F.when(F.col("l_suppkey") % 25 > 0, "null").alias("direction"),
        F.lit("direct").alias("directness"), F.lit("A1").alias("tier"), F.when(F.col("l_partkey") % 20 > 0, "frailty_x").otherwise("Frailty").alias("outcome"),
    )
    return revision.sources_intact(rows, "id")


@query("certification_pack_floors", """
    with o as (select *, o_orderkey % 3 as f, o_orderkey % 11 as t from orders)
    select o_orderkey as id, case when t + 0.0 >= case f when 0 then 8.0 when 1 then 4.0 else 20.0 end then 'AAA-INF' when t + 0.0 >= case f when 0 then 6.0 when 1 then 3.0 else 7.0 end then 'AAA-MECH' else 'SCOP' end as track from o""")
def certification_pack_floors(spark, sf_dir):
    """Inference and mechanism weights that packs set, or leave as they are."""
    f, t = F.col("o_orderkey") % 3, (F.col("o_orderkey") % 11).cast("double")
    profile = {"total": t, "clinical": F.lit(0.0), "mechanistic": F.greatest(t, F.lit(2.0)), "direct": F.lit(0.0), "a_tier": F.lit(1.0), "a1_direct": F.lit(0), "n_mechanistic": F.lit(5)}
    floors = {"inferential_weight": F.when(f == 1, 4.0).when(f == 2, 20.0), "mechanistic_weight": F.when(f == 1, 3.0).when(f == 2, 7.0)}
    track = verdicts.certification(F.lit(1000), F.lit(1000), F.lit(0), profile, floors)["track"]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), track.alias("track"))


#: (lines, broken rules as (line of the fragment, code, severity)).
LINES = [
    ("# ## Twice", [(0, "malformed_header", "P1")]), ("## Empty\n# Next", [(0, "empty_heading", "P2")]), ("| a | b |\n|  | |", [(1, "blank_table_row", "P2")]), ("| a | b |\n| c |", [(0, "malformed_table_row", "P2")]),
    ("A paragraph that goes on for more than sixty characters and stops without", [(0, "unterminated_paragraph", "P2")]), ("Text here.\n\n_Cited: A 2020._", [(2, "orphan_citation", "P1")]), ("# Head\n_Cited: B 2021._", [(1, "orphan_citation", "P1")]),
    ("THIS LINE IS ALL IN CAPITALS.", [(0, "shouting", "P2")]), ("a | b | c | d | e | f | g.", [(0, "menu_line", "P2")]), ("Fine.\n_Cited: C 2022._", []),
]


def _two(spark, sf_dir, parts, joint, end):
    at = lambda c: F.get(F.array(*map(F.lit, parts)), (F.col(c) % len(parts)).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(at("o_orderkey"), F.lit(joint), at("o_custkey"), F.lit(end)).alias("text"))


_L = len(LINES)


@query("line_rules_fired", f"""
    with f(k, line, code, severity, detail) as (values {_values([(i, n, c, s, t.split(chr(10))[n]) for i, (t, bad) in enumerate(LINES) for n, c, s in bad])}), size(k, n) as (values {_values([(i, t.count(chr(10)) + 1) for i, (t, _) in enumerate(LINES)])}),
    d as (select o_orderkey as id, o_orderkey % {_L} as k, 1 as base from orders union all select o_orderkey, o_custkey % {_L}, n + 2 from orders join size on size.k = o_orderkey % {_L})
    select id, code, severity, cast(base + line as int) as place, detail from d join f using (k)""")
def line_rules_fired(spark, sf_dir):
    rows = issues.lines(_two(spark, sf_dir, [t for t, _ in LINES], "\nText.\n", "\nText."), "id", "text")
    return issues.issues(rows, "id", F.col("n"), F.col("line"), issues.line_rules())


SENTENCES = [
    ("The effect was not significant (p = 0.03).", "significance_wording", "P1"), ("A significant effect (p = 0.2).", "significance_overclaim", "P1"), ("Smith et al., 2031 found it.", "future_citation", "P1"), ("5 is below 3 in this table.", "arithmetic", "P1"), ("2 above 7 here.", "arithmetic", "P1"),
    ("There was no change (12%) at all.", "no_change_nonzero", "P1"), ("It was,, odd.", "double_punctuation", "P2"), ("Text (tbd) here.", "template_artifact", "P1"), ("The the end.", "repeated_word", "P2"), ("We read A1_clin labels.", "internal_label", "P1"), ("Nothing wrong here.", None, None),
]


@query("sentence_rules_fired", f"with f(k, s, code, severity) as (values {_values([(i, *x) for i, x in enumerate(SENTENCES)])}) select o_orderkey as id, code, severity, cast(o_custkey as int) as place, s as detail from orders join f on k = o_orderkey % {len(SENTENCES)} where code is not null")
def sentence_rules_fired(spark, sf_dir):
    text = F.get(F.array(*[F.lit(s) for s, *_ in SENTENCES]), (F.col("o_orderkey") % len(SENTENCES)).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", text.alias("s"))
    return issues.issues(rows, "id", F.col("o_custkey"), F.col("s"), issues.sentence_rules(2026))


#: (text, broken rules).
DOCUMENTS = [("## Results\nSix words stand in this text.", []), ("## Results\nFew.", ["thin"]), ("No heading stands in this text.", ["missing_results"]), ("# results\nSome words.\n## References\nA\n## References\nB", ["duplicate_references"]), ("", ["thin", "missing_results"])]


@query("document_rules_fired", f"""
    with f(k, code, severity, detail) as (values {_values([(i, c, "P1" if c == "duplicate_references" else "P2", t) for i, (t, cs) in enumerate(DOCUMENTS) for c in cs])}) select o_orderkey as id, code, severity, 0 as place, detail from orders join f on k = o_orderkey % {len(DOCUMENTS)}""")
def document_rules_fired(spark, sf_dir):
    rows = _picked(spark, sf_dir, [F.lit(t) for t, _ in DOCUMENTS]).withColumnRenamed("x", "text")
    rows = rows.withColumn("n_words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    return issues.issues(rows, "id", F.lit(0), F.col("text"), issues.document_rules(("results",), 5))
