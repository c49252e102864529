"""Queries of run artifacts, JSON in text, folded letters, term maps and accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.unfold import LETTERS, ascii_fold, json_in
from weft.operators import accounting
from weft.plans.outcomes import _values
from weft.plans.tables import registrar, table
from weft.sources import runs

QUERIES, SQL, query = registrar()


def run_files(spark, sf_dir):
    """Orders as runs: their lines are receipts. Every eleventh lacks its manifest, every thirteenth has its verdict cut short, every third has a contract."""
    k = F.col("l_orderkey")
    line = table(spark, sf_dir, "lineitem")
    receipt = F.struct(
        F.concat(F.lit("o"), F.col("l_partkey") % 4).alias("outcome_class"), F.col("l_returnflag").alias("directness"), F.concat(F.lit("T"), F.col("l_linenumber") % 3).alias("evidence_tier"),
        F.get(F.array(F.lit("positive"), F.lit("negative"), F.lit("")), (F.col("l_suppkey") % 3).cast("int")).alias("effect_direction"),
    )
    source = F.struct(F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("10.1/A"), F.col("l_partkey") % 50)).alias("source_doi"), F.when(F.col("l_partkey") % 2 > 0, F.concat(F.lit("P"), F.col("l_suppkey"))).alias("source_pmid"))
    g = line.groupBy("l_orderkey").agg(F.collect_list(receipt).alias("receipts"), F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("R"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), source))).alias("registry"), F.count("*").alias("n"))
    run = F.when(k % 5 == 0, F.concat(F.lit("run"), k)).otherwise(F.concat(F.lit("synthesis-topic"), k % 7, F.lit("-v"), k))
    verdict = F.to_json(F.struct(F.when(k % 4 == 0, "AA").otherwise("AAA").alias("verdict"), (k % 8).alias("maturity_level"), F.concat(F.lit("L"), k % 8).alias("maturity_label"), F.when(k % 6 == 0, "SCOPED").otherwise("FULL").alias("certification_track"), (k % 3 == 0).alias("journal_ready")))
    manifest = F.to_json(F.struct(F.when(k % 4 > 0, F.col("n") + 1).alias("n_receipts"), F.when(k % 5 > 0, F.col("n")).alias("n_accepted_receipts"), (k % 9).alias("n_non_orthogonal_tensions"), (k % 10).alias("n_high_confidence_claims_total"), "receipts"))
    contents = {
        runs.VERDICT: F.when(k % 13 == 0, F.substring(verdict, 1, 20)).otherwise(verdict), runs.MANIFEST: F.when(k % 11 > 0, manifest), runs.REGISTRY: F.to_json("registry"),
        runs.CONTRACT: F.when(k % 3 == 0, F.lit('{"canonical_counts": {"source_papers": 9, "tensions": 2, "accepted_papers": 0}}')), "notes.txt": F.lit("not read"),
    }
    files = F.array(*[F.struct(F.concat(F.lit("/runs/"), run, F.lit(f"/{n}")).alias("path"), c.alias("content")) for n, c in contents.items()])
    return g.select(F.inline(files)).where("content is not null")


def _pairs(m: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


_RUNS = """
    l as (select l_orderkey as k, l_linenumber as i, 'o' || (l_partkey % 4) as outcome, l_returnflag as directness, 'T' || (l_linenumber % 3) as tier, case l_suppkey % 3 when 0 then 'positive' when 1 then 'negative' else 'unknown' end as direction,
                 lower(case when l_partkey % 3 > 0 then '10.1/A' || (l_partkey % 50) when l_partkey % 2 > 0 then 'P' || l_suppkey else concat_ws('-', 'R' || l_orderkey, l_linenumber, l_partkey, l_suppkey) end) as cited from lineitem),
    g as (select k, count(*) as n from l group by k),
    r as (select k, n, case when k % 5 = 0 then 'run' || k else 'synthesis-topic' || (k % 7) || '-v' || k end as run_id, case when k % 5 = 0 then 'run' || k else 'topic' || (k % 7) end as topic, k % 11 > 0 and k % 13 > 0 as whole,
                 case when k % 11 = 0 then 'missing artifacts: manifest.json' when k % 13 = 0 then 'unreadable artifacts: full_paper.final_verdict.json' end as exclusion_reason from g)"""


def _mix(field: str) -> str:
    return f"(select string_agg({field} || '=' || c, ';' order by {field}) from (select {field}, count(*) as c from l where l.k = r.k group by {field}))"


@query("run_summaries", f"""
    with {_RUNS}, p as (select *, case when whole and k % 3 = 0 then 9 when whole and k % 4 > 0 then n + 1 when whole then n else 0 end as papers0 from r),
    q as (select *, case when papers0 = 0 and k % 3 = 0 then 9 else papers0 end as papers, case when k % 3 = 0 then 2 when whole then k % 9 else 0 end as public from p)
    select run_id, topic, case when not whole or k % 4 = 0 then 'excluded' when k % 6 = 0 then 'scoped_support' when k % 8 >= 5 and k % 3 = 0 then 'full_aaa_primary' when k % 8 >= 4 then 'analytical_support' else 'scoped_support' end as eligibility,
           case when whole then case when k % 4 = 0 then 'AA' else 'AAA' end else '' end as verdict, case when whole then k % 8 else 0 end as maturity_level, papers as n_source_papers,
           case when whole and k % 5 > 0 then n else papers end as n_accepted_papers, public as n_public_tensions, case when whole and k % 9 > 0 then k % 9 else public end as n_pipeline_tensions, case when whole then k % 10 else 0 end as n_high_confidence_claims,
           case when whole then {_mix('directness')} else '' end as directness_mix, case when whole then {_mix('direction')} else '' end as effect_direction_mix,
           case when whole then (select string_agg(x || '=' || c, ';' order by x) from (select outcome || '/' || direction as x, count(*) as c from l where l.k = q.k group by x)) else '' end as outcome_effects,
           case when whole then (select string_agg(distinct outcome, ';' order by outcome) from l where l.k = q.k) else '' end as outcome_domains,
           case when whole then (select string_agg(distinct cited, ';' order by cited) from l where l.k = q.k) else '' end as citation_keys, exclusion_reason
    from q""".replace("l.k = r.k", "l.k = q.k"))
def run_summaries(spark, sf_dir):
    s = runs.run_summaries(run_files(spark, sf_dir))
    plain = ["run_id", "topic", "eligibility", "verdict", "maturity_level", "n_source_papers", "n_accepted_papers", "n_public_tensions", "n_pipeline_tensions", "n_high_confidence_claims"]
    return s.select(*plain, *[_pairs(m).alias(m) for m in ("directness_mix", "effect_direction_mix", "outcome_effects")], *[F.array_join(c, ";").alias(c) for c in ("outcome_domains", "citation_keys")], "exclusion_reason")


@query("field_citations", f"with {_RUNS} select cited as citation_key, count(distinct k) as n_topics from l join r using (k) where whole group by cited")
def field_citations(spark, sf_dir):
    return runs.field_citations(runs.run_summaries(run_files(spark, sf_dir)))


@query("receipt_folders", """
    select case when s_suppkey % 3 = 0 then 'r' || s_suppkey else 'sub' || s_suppkey end as receipt_id, case when s_suppkey % 3 = 0 then '' else 'topic' || s_nationkey end as topic, case when s_suppkey % 5 = 0 then 0 else 2 end as n_cards,
           concat_ws(', ', case when s_suppkey % 3 = 0 then 'run_metadata.json' end, case when s_suppkey % 4 = 0 then 'claim_graph.json' end, case when s_suppkey % 5 = 0 then 'evidence_cards.json' end) as missing from supplier""")
def receipt_folders(spark, sf_dir):
    """Suppliers as receipts, some files cut short or absent; a card is stated twice and one has no source."""
    k = F.col("s_suppkey")
    cards = '[{"source": {"ref": "a"}}, {"source": {"ref": "b"}}, {"source": {"ref": "a"}}, {"other": 1}]'
    contents = {
        "run_metadata.json": F.when(k % 3 == 0, "{").otherwise(F.to_json(F.struct(F.concat(F.lit("sub"), k).alias("submission_id"), F.concat(F.lit("topic"), "s_nationkey").alias("topic")))),
        "claim_graph.json": F.when(k % 4 > 0, "{}"), "spar_review.json": F.lit("{}"), "evidence_cards.json": F.when(k % 5 == 0, cards[:30]).otherwise(cards),
    }
    files = F.array(*[F.struct(F.concat(F.lit("/receipts/r"), k, F.lit(f"/{n}")).alias("path"), c.alias("content")) for n, c in contents.items()])
    return runs.receipts(table(spark, sf_dir, "supplier").select(F.inline(files)).where("content is not null"))


@query("topic_pack_files", """
    select '/packs/' || n_nationkey || '.toml' as path, case when n_nationkey % 4 > 1 then n_name end as topic, case when n_nationkey % 4 > 1 then 2 end as n_aliases, case when n_nationkey % 4 > 1 then n_regionkey + 0.5 end as floor,
           case n_nationkey % 4 when 0 then 'not TOML' when 1 then 'no topic' end as problem from nation""")
def topic_pack_files(spark, sf_dir):
    """Nations as packs; one in four is no TOML, one in four names no topic."""
    name = F.concat(F.lit('topic = "'), "n_name", F.lit('"\naliases = ["a", "b"]\nextra = 1\n[cert_floors]\nweight = '), "n_regionkey", F.lit(".5\n"))
    text = F.when(F.col("n_nationkey") % 4 == 0, "topic = [").when(F.col("n_nationkey") % 4 == 1, 'topic = " "\n').otherwise(name)
    packs = runs.topic_packs(table(spark, sf_dir, "nation").select(F.concat(F.lit("/packs/"), "n_nationkey", F.lit(".toml")).alias("path"), text.alias("content")))
    return packs.select("path", "pack.topic", F.when(F.col("pack").isNotNull(), F.size("pack.aliases")).alias("n_aliases"), F.try_element_at("pack.cert_floors", F.lit("weight")).alias("floor"), "problem")


def _picked(spark, sf_dir, values, key="o_orderkey"):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.get(F.array(*values), (F.col(key) % len(values)).cast("int")).alias("x"))


#: (text, the first object in it).
REPLIES = [
    ('Here: {"a": 1}', '{"a":1}'), ('<think>{"no": 1}</think>{"b": [1, {"c": "}"}]} tail {"d": 2}', '{"b":[1,{"c":"}"}]}'), ('```json\n{"e": "x\\"{y"}\n```', '{"e":"x\\"{y"}'), ("{not json} then {\"f\": null}", '{"f":null}'), ('{"g": {"h": 1}', '{"h":1}'),
    ("no object", None), ("", None), ('[{"i": true}]', '{"i":true}'), ('{"j": "open', None), ('text } { "k" : { } } }', '{"k":{}}'), ('before ```\n{"l": 1}\n``` after {"m": 2}', '{"l":1}'), ("{}", "{}"), ('{"n": "\\\\"} "{', '{"n":"\\\\"}'),
]


@query("json_in_text", f"with t(k, object) as (values {_values([(i, o) for i, (_, o) in enumerate(REPLIES)])}) select o_orderkey as id, object from orders join t on k = o_orderkey % {len(REPLIES)}")
def json_in_text(spark, sf_dir):
    return _picked(spark, sf_dir, [F.lit(t) for t, _ in REPLIES]).select("id", F.to_json(json_in(F.col("x"))).alias("object"))


def _letters_sql(text: str) -> str:
    for a, b in LETTERS.items():
        text = f"replace({text}, '{a}', '{b}')"
    return f"strip_accents({text})"


@query("ascii_fold", f"select doc_id, md5({_letters_sql('text')}) as folded from documents")
def folded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(ascii_fold(F.col("text"))).alias("folded"))


TERMS = [("heart attack", "myocardial infarction"), ("attack", "onset"), ("attack rate", "incidence"), ("BP", "blood pressure"), ("bp", "blood pressure"), ("", "nothing"), ("high bp", "hypertension"), ("ü", "ue")]
#: (text, text with canonical names, names).
SAID = [
    ("A Heart attack rate rose.", "a myocardial infarction rate rose.", "myocardial infarction"), ("High BP and bp.", "hypertension and blood pressure.", "hypertension,blood pressure"), ("attack rate: attack", "incidence: onset", "incidence,onset"),
    ("attacks, bpm", "attacks, bpm", ""), ("", "", ""), ("BP", "blood pressure", "blood pressure"), ("nothing said", "nothing said", ""),
]


@query("normalised_terms", f"with t(k, text, terms) as (values {_values([(i, t, n) for i, (_, t, n) in enumerate(SAID)])}) select o_orderkey as id, text, terms from orders join t on k = o_orderkey % {len(SAID)}")
def normalised_terms(spark, sf_dir):
    rows = _picked(spark, sf_dir, [F.lit(t) for t, *_ in SAID]).withColumnRenamed("x", "text")
    return accounting.normalised_terms(rows, spark.createDataFrame(TERMS, "term string, name string")).select("id", "text", F.array_join("terms", ",").alias("terms"))


@query("plain_terms", r"select item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b[A-Za-z][A-Za-z0-9-]{3,}\b')))[1:200], ',') as terms from benchmark")
def plain_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(accounting.plain_terms(F.col("text")), ",").alias("terms"))


_R = "Outcome-class roster: "
#: (text, receipts as (outcome, direction, directness), mismatches as (outcome, field, label, stated, saved, kind)).
ROSTERS = [
    (_R + "Frailty n=2 (direction: null=1; positive=1; directness: direct=2; sources: A; B); Safety n=1 (direction: null=1; directness: indirect=1; sources: C).", [("Frailty", "null", "direct"), ("Frailty", "positive", "direct"), ("Safety", "null", "indirect")], []),
    ("Text.\n" + _R + "Frailty n=3 (direction: positive=3; directness: direct=2; sources: A).\nMore.", [("Frailty", "positive", "direct")] * 2, [("Frailty", "n", "", 3, 2, "unequal"), ("Frailty", "direction", "positive", 3, 2, "unequal")]),
    (_R + "Frailty n=1 (direction: mixed=1; directness: direct=1; sources: A).", [("Frailty", "positive", "direct")], [("Frailty", "direction", "mixed", 1, None, "extra"), ("Frailty", "direction", "positive", None, 1, "lost")]),
    (_R + "Frailty n=1 (direction: null=1; directness: direct=1; sources: A).", [("Frailty", "null", "direct"), ("Safety", "null", "direct")], [("Safety", "n", "", None, 1, "lost"), ("Safety", "direction", "null", None, 1, "lost"), ("Safety", "directness", "direct", None, 1, "lost")]),
    ("No roster here.", [("Frailty", "null", "direct")], []), (_R + "Frailty n=4 (direction: null=4; directness: direct=4; sources: A).", [], []),
]


@query("accounting_mismatches", f"""with t(k, outcome, field, label, stated, saved, kind) as (values {_values([(i, *m) for i, (*_, ms) in enumerate(ROSTERS) for m in ms])})
    select o_orderkey as id, outcome, field, label, cast(stated as bigint) as stated, cast(saved as bigint) as saved, kind from orders join t on k = o_orderkey % {len(ROSTERS)}""")
def accounting_mismatches(spark, sf_dir):
    receipts = [F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(d).alias("direction"), F.lit(x).alias("directness")) for o, d, x in rs]).cast("array<struct<outcome:string,direction:string,directness:string>>") for _, rs, _ in ROSTERS]
    rows = _picked(spark, sf_dir, receipts).select("id", F.inline("x"))
    return accounting.accounting_mismatches(_picked(spark, sf_dir, [F.lit(t) for t, *_ in ROSTERS]).withColumnRenamed("x", "text"), rows)


#: (text, places and forms of clauses that call an accepted source rejected); Smith 2020 ABC-TRIAL and Lee are accepted.
REJECTED = [
    ("Smith 2020 was rejected by REVIEW. It held.", [(0, "Smith")]), ("Smith 2020 held. Jones was rejected.", []), ("While Jones was rejected by REVIEW, Smith 2020 held.", []), ("We saw much; the ABC TRIAL did not pass REVIEW.", [(0, "ABC")]),
    ("Fine.\n\nLee was not here.\n\nThe Smithson paper was rejected.", []), ("It was quarantined by REVIEW as ABC-TRIAL.", [(0, "ABC")]), ("", []),
]


@query("accepted_called_rejected", f"with t(k, place, form) as (values {_values([(i, *m) for i, (_, ms) in enumerate(REJECTED) for m in ms])}) select o_orderkey as id, place as at, form from orders join t on k = o_orderkey % {len(REJECTED)}")
def accepted_called_rejected(spark, sf_dir):
    papers = _picked(spark, sf_dir, [F.lit(t) for t, _ in REJECTED]).withColumnRenamed("x", "text")
    receipts = papers.select("id", F.explode(F.array(F.lit("Smith_2020_ABC_TRIAL_agent"), F.lit("Lee_note"), F.lit(""))).alias("receipt_id"))
    return accounting.accepted_called_rejected(papers, receipts, "REVIEW")


@query("unnamed_receipts", "select l_orderkey as id, count(*) as n from lineitem where l_linenumber % 4 = 0 group by l_orderkey")
def unnamed_receipts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 4 > 0, F.concat(F.lit("R"), "l_linenumber")).when(F.col("l_linenumber") == 4, " ").alias("receipt_id"))
    return accounting.unnamed_receipts(rows)
