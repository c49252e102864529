"""Queries of manuscript checks. Manuscripts are put together from fragments by each order's key.

Each fragment says which rules it breaks; the SQL lists those, so that it shares no
pattern with the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import issues, surface
from weft.plans.tables import registrar, spread, table

QUERIES, SQL, query = registrar()

_TABLE = "| Outcome class | Sources |\n|---|---|\n| Frailty | n=3 |\n| Safety | n=2 |\n\n### Frailty Outcomes\n"
_SAFETY = "\n\n### Safety Outcomes\nIt covers 2 studies."
_D = "**Thesis:** Agent may help.\n\nEvidence suggests limits; it might be uncertain and preliminary.\n\n**Resolution criteria:** A trial."
#: Section: divisor of the key, and fragments (text, broken rules of the paper, of a paragraph, of a sentence). None leaves the section out.
FRAGMENTS = {
    "Abstract": (1, [
        ("The agent was studied in adults.", [], [], []), ("Text (potentially) here.", ["repair_artifact"], [], []), ("In humans in humans it worked.", ["duplicate_phrase"], [], []), ("We propose a novel framework for agent.", [], ["unsupported_novelty"], []),
        ("We propose a method that extends Smith 2020 findings.", [], [], []), ("There were 0 mechanistic sources in view.", ["abstract_contradiction"], [], []), ("Evidence is stated in study(s) of agent.", ["unresolved_template"], [], []),
        ("The statistic was not reported; the work was human-verified.", ["unresolved_statistic", "human_verification"], [], []), ("one two three four five six seven eight nine ten eleven twelve", ["long_abstract"], [], []), ("Short.", ["short_abstract"], [], []),
    ]),
    "Methods": (3, [
        ("Searches were run; mechanistic sources were kept.", [], [], []), ("Two researchers manually reviewed mechanistic papers.", ["fabricated_methods"], [], []), ("No manual review of mechanistic papers was done.", [], [], []), ("The mechanistic receipts were kept.", ["pipeline_jargon"], [], []),
        ("Bias was rated by RoB-2 on mechanistic studies.", ["unbacked_appraisal"], [], []), ("Mechanistic texts use A1_clinical labels.", ["internal_tier_label"], [], []), ("Mechanistic work is thought to is sound.", ["grammar_artifact"], [], []),
        ("Mechanistic text [citation needed] was kept.", ["citation_artifact"], [], []), ("| Directness | mechanistic |", ["classification_row"], [], []),
    ]),
    "Results": (5, [
        (_TABLE + "This spans 3 sources." + _SAFETY, ["classification_row"], [], []), (_TABLE + "This spans 3 sources.", ["classification_row", "missing_outcome_section"], [], []), (_TABLE + "This spans 3 sources." + _SAFETY + "\n\n### Mortality Outcomes\nNone died.", ["classification_row", "unexpected_outcome_section"], [], []),
        (_TABLE + "This spans 3 sources." + _SAFETY + _SAFETY, ["classification_row", "duplicate_outcome_section"], [], []), (_TABLE + "This spans 5 sources." + _SAFETY, ["classification_row", "count_mismatch"], [], []), ("Agent had effects, see Table 9.", ["orphan_table"], [], []),
        (_TABLE + _SAFETY.strip(), ["classification_row", "empty_heading"], [], []), ("Agent had effects.", [], [], []), ("Agent had effects, see Table 1.\n\nTable 1: effects.", [], [], []),
    ]),
    "Discussion": (7, [
        (_D, [], [], []), ("Agent may help; evidence suggests it might be uncertain.\n\n**Resolution criteria:** A trial.", ["no_thesis"], [], []), ("**Thesis:** Agent may help.\n\nEvidence suggests limits; it might be uncertain and preliminary.", ["no_resolution"], [], []),
        ("**Thesis:** Agent helps.\n\n**Resolution criteria:** A trial.", ["low_hedging"], [], []), (_D + "\n\nMay.", [], ["hedge_fragment"], []), (_D + "\n\nSmith 2020 reported.", [], ["citation_only_stub"], []), (_D + "\n\nUndoubtedly agent works.", [], [], ["template_p1"]),
        (_D + "\n\nFurther research is needed.", [], [], ["template_p2"]), (_D + "\n\nThe trial compared agent with placebo and", [], ["truncated"], []), (_D + "\n\nThe trial (of agent was run.", [], ["unbalanced_parentheses"], []), (_D + "\n\nMice were healed by agent in the cage. It is good.", [], [], ["unhedged_preclinical"]),
        (_D + "\n\nAs shown by Smith et al. 2020. It held.", [], ["sentence_end_authoryear"], []), (_D + "\n\nIt was done. on 2019 in a cohort.", [], [], ["fragment_lowercase_start"]), (_D + "\n\nIt was done. e when paired.", [], [], ["fragment_single_letter"]),
        (_D + "\n\nMechanistically, findings agree with theory here.", [], ["thin_analysis"], []),
    ]),
    "Limitations": (11, [("Samples were small here.", [], [], []), ("Positive signals appear in adults.", ["limitations_leak"], [], []), ("The evidence base is limited here.", [], [], ["vague_limitation"]), (None, ["missing_limitations"], [], []), ("Few.", ["short_limitations"], [], [])]),
    "Conclusion": (13, [
        ("Agent needs trials.", [], [], []), ("This separates endpoint-specific evidence.", ["conclusion_scope"], [], []), ("Agent decreased lifespan by 5 years.", ["polarity"], [], []), ("We read PMC1234567 and Smith_2020_trial_x files.", ["internal_handle"], [], []), ("We read nothing.", [], [], []),
    ]),
    "References": (17, [("Smith J. Smith 2020. Title.", [], [], []), (None, ["missing_references"], [], []), ("Smith 2020.\n\n## References\nSmith 2020.", ["duplicate_references"], [], [])]),
}


def _literal(text: str) -> str:
    return "concat(" + ", chr(10), ".join(f"'{x}'" for x in text.split("\n")) + ", '')"


def _pick(divisor: int, values: list[str]) -> str:
    key = f"cast(floor(o_orderkey / {divisor}) as bigint) % {len(values)}"
    return f"case {key} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


_TEXT = "concat(" + ", ".join(_pick(d, ["''" if t is None else _literal(f"## {name}\n{t}\n\n") for t, *_ in fragments]) for name, (d, fragments) in FRAGMENTS.items()) + ")"


def _broken(level: int) -> str:
    parts = [f"select o_orderkey as id, unnest({_pick(d, [str(f[level]) if f[level] else '[]::varchar[]' for f in fragments])}) as code from orders" for d, fragments in FRAGMENTS.values()]
    return "select distinct id, code from (" + " union all ".join(parts) + ")"


def texts(keys):
    return keys.withColumn("text", F.expr(_TEXT))


def papers(spark, sf_dir):
    return surface.manuscripts(texts(spread(table(spark, sf_dir, "orders").select("o_orderkey"))), "o_orderkey", "text")


def found(spark, sf_dir, judge):
    """(id, code) of what judge finds in the manuscripts of all orders. A text that orders share is read once, as that of its least key: only keys and hashes are shuffled."""
    cores = 4 * spark.sparkContext.defaultParallelism
    keys = table(spark, sf_dir, "orders").select("o_orderkey").repartition(cores, "o_orderkey").distinct()
    # A hash that may be null would be made in the scan already, to see whether it is; by its file's size the table would be broadcast.
    signed = texts(keys).select("o_orderkey", F.coalesce(F.unhex(F.md5("text")), F.expr("X''")).alias("signed"))
    first = spread(signed.groupBy("signed").agg(F.min("o_orderkey").alias("o_orderkey")))
    codes = judge(surface.manuscripts(texts(first), "signed", "text")).groupBy(F.col("id").alias("signed")).agg(F.collect_set("code").alias("codes"))
    return signed.hint("merge").join(codes, "signed").select(F.col("o_orderkey").alias("id"), F.explode("codes").alias("code"))


@query("paper_issues", _broken(1))
def paper_issues(spark, sf_dir):
    rules = surface.paper_rules({"Abstract": 3, "Limitations": 2}, {"Abstract": 11}, 0, 4, 0, (0, 0.0))
    return found(spark, sf_dir, lambda made: issues.issues(surface.judged(made), "id", F.lit(0), F.lit(""), rules))


@query("paragraph_issues", _broken(2))
def paragraph_issues(spark, sf_dir):
    return found(spark, sf_dir, lambda made: issues.issues(surface.paragraphs(made), "id", F.col("n"), F.col("p"), surface.paragraph_rules()))


@query("surface_sentence_issues", _broken(3))
def surface_sentence_issues(spark, sf_dir):
    return found(spark, sf_dir, lambda made: issues.issues(surface.sentences(made), "id", F.col("n"), F.col("s"), surface.sentence_rules()))


_NAMES = ["Abel 2001", "Baker 2002", "Clark 2003", "Davis 2004"]
_C1, _C2 = (_pick(d, [f"'{n}'" for n in _NAMES]) for d in (1, 4))
_KINDS = ["narrative_review", "systematic_review", "evidence_map", "management_literature_review"]
_SELF = ["We conducted a systematic review of agent.", "This is not a systematic review of agent.", "We conducted a search; many authors of other papers that we read for context in this work wrote a systematic review.", "This is a scoping review of agent.", "We cite systematic reviews."]


def named(spark, sf_dir, text: str, **columns: str):
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.expr(text).alias("text"), *[F.expr(v).alias(k) for k, v in columns.items()])
    return surface.manuscripts(o, "o_orderkey", "text").join(o.select(F.col("o_orderkey").alias("id"), *columns), "id") if columns else surface.manuscripts(o, "o_orderkey", "text")


def sources(spark, sf_dir, **columns):
    """Four sources with what is known of them, one row each, from the regions' keys."""
    at = lambda v: F.get(F.array(*map(F.lit, v)), F.col("r_regionkey"))
    return table(spark, sf_dir, "region").where("r_regionkey < 4").select(at(_NAMES).alias("citation"), *[at(v).alias(k) for k, v in columns.items()])


@query("review_overclaims", f"""with o as (select o_orderkey as id, {_pick(4, [f"'{k}'" for k in _KINDS])} as kind, cast(floor(o_orderkey / 1) as bigint) % 5 as v from orders)
    select id, 'systematic review' as term from o where v = 0 and kind <> 'systematic_review' union all select id, 'scoping review' from o where v = 3 and kind in ('narrative_review', 'evidence_map')""")
def review_overclaims(spark, sf_dir):
    text = f"concat('## Abstract', chr(10), {_pick(1, [repr(s) for s in _SELF])}, chr(10))"
    return surface.overclaims(named(spark, sf_dir, text, declared=_pick(4, [f"'{k}'" for k in _KINDS])), "declared")


@query("misrouted_citations", f"with o as (select o_orderkey as id, {_C1} as c1, {_C2} as c2 from orders) select distinct id, unnest([c1, c2]) as citation, 'frailty' as section from o where c1 in ('Clark 2003', 'Davis 2004') and c2 in ('Clark 2003', 'Davis 2004')")
def misrouted_citations(spark, sf_dir):
    text = f"concat('## Results', chr(10), '### Frailty Outcomes', chr(10), 'Seen in ', {_C1}, ' and ', {_C2}, '. Other text.')"
    return surface.misrouted(named(spark, sf_dir, text), sources(spark, sf_dir, outcome=["frailty", "Frailty Outcomes", "safety", "mortality"]))


@query("unlabelled_animals", f"with o as (select o_orderkey as id, {_C1} as c1 from orders where o_orderkey % 3 <> 0) select id, c1 as citation from o where c1 = 'Clark 2003'")
def unlabelled_animals(spark, sf_dir):
    text = f"concat('## Results', chr(10), chr(10), case when o_orderkey % 3 = 0 then 'In mice ' else 'In all ' end, {_C1}, ' ran.')"
    return surface.unlabelled_animals(named(spark, sf_dir, text), sources(spark, sf_dir).where("citation = 'Clark 2003'"))


_SAYS = ["improved gait", "reduced gait", "left gait unchanged", "measured gait"]


@query("prose_directions", f"""with o as (select o_orderkey as id, {_C1} as citation, {_pick(4, ["'positive'", "'negative'", "'null'", "null"])} as stated from orders), c as (select *, case citation when 'Abel 2001' then 'positive' when 'Baker 2002' then 'negative' when 'Clark 2003' then 'null' else 'mixed' end as coded from o) select id, citation, coded, stated from c where stated <> coded""")
def prose_directions(spark, sf_dir):
    text = f"concat('## Results', chr(10), {_C1}, ' ', {_pick(4, [repr(s) for s in _SAYS])}, '.')"
    return surface.prose_mismatches(named(spark, sf_dir, text), sources(spark, sf_dir, direction=["benefit", "harm", "no_effect", "odd"]))


@query("overgrouped_citations", f"""with o as (select o_orderkey as id, {_C1} as c1, {_C2} as c2 from orders), d as (select id, list_sort(list_distinct(list_transform([c1, c2], lambda c: case c when 'Abel 2001' then 'positive' when 'Baker 2002' then 'negative' when 'Clark 2003' then 'null' else 'mixed' end))) as ds from o) select id, 1 as n, array_to_string(ds, ',') as directions from d where len(ds) > 1""")
def overgrouped_citations(spark, sf_dir):
    text = f"concat('## Abstract', chr(10), 'Seen in ', {_C1}, ' and ', {_C2}, '. More.')"
    return surface.overgrouped(named(spark, sf_dir, text), sources(spark, sf_dir, direction=["benefit", "harm", "no_effect", "odd"])).withColumn("directions", F.array_join("directions", ","))


RECEIPT = {
    "receipt_id": "case when p_partkey % 11 = 0 then ' ' else concat('Smith_', cast(1985 + p_partkey % 50 as string), '_study_', cast(2000 + p_partkey % 40 as string)) end", "year": "2000 + p_partkey % 40",
    "title": "case p_partkey % 5 when 0 then 'Meta-analysis of agent' when 1 then 'A randomised controlled trial of agent' when 2 then 'Systematic review of randomized controlled trials' when 3 then 'Cohort study of agent' else 'Agent' end",
    "directness": "case p_partkey % 3 when 0 then 'direct' when 1 then 'review' else 'indirect' end", "label": "case p_partkey % 7 when 0 then 'PMC1234567' when 1 then 'Smith_2020' when 2 then 'DOI_x' when 3 then 'Correction 2020' else 'Smith 2020' end",
}


@query("receipt_issues", f"""with r as (select p_partkey, {', '.join(f'{v} as {k}' for k, v in RECEIPT.items())} from part)
    select p_partkey as id, 'missing_receipt_id' as code from r where p_partkey % 11 = 0 union all select p_partkey, 'directness_coding' from r where (directness = 'direct' and p_partkey % 5 in (0, 2)) or (directness = 'review' and p_partkey % 5 in (1, 3))
    union all select p_partkey, 'future_citation' from r where year > 2026 union all select p_partkey, 'blocked_label' from r where p_partkey % 7 < 4""")
def receipt_issues(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in RECEIPT.items()])
    return issues.issues(r, "p_partkey", F.lit(0), F.lit(""), surface.receipt_rules(2026)).select("id", "code")


AUTHOR = {"author": "case p_partkey % 6 when 0 then 'María Hernández' when 1 then 'Jan van de Werf' when 2 then '' when 3 then 'O''Brien' when 4 then 'Ada Smith-Jones' else 'müller' end", "stated_year": "case p_partkey % 4 when 0 then '2020' when 1 then '2035' when 2 then 'soon' else '1985' end"}


@query("body_citations", f"""with r as (select p_partkey, {AUTHOR['author']} as author, {AUTHOR['stated_year']} as y, {RECEIPT['receipt_id']} as rid from part), k as (select *, case author when 'María Hernández' then 'Hernandez' when 'Jan van de Werf' then 'Werf' when '' then null when 'O''Brien' then 'OBrien' when 'Ada Smith-Jones' then 'Smith-Jones' else 'Muller' end as name, case when y = '2020' then 2020 end as py from r)
    select p_partkey, name || ' ' || coalesce(cast(py as varchar), 'n.d.') as label, py as year, case when p_partkey % 11 = 0 then null when 2000 + p_partkey % 40 <= 2026 then 2000 + p_partkey % 40 when 1985 + p_partkey % 50 between 1990 and 2026 then 1985 + p_partkey % 50 end as id_year from k""")
def body_citations(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_partkey", F.expr(AUTHOR["author"].replace("O''Brien", "O\\'Brien")).alias("author"), F.expr(AUTHOR["stated_year"]).alias("y"), F.expr(RECEIPT["receipt_id"]).alias("rid"))
    return r.select("p_partkey", surface.body_citation(F.col("author"), F.col("y"), 2026).alias("label"), surface.publication_year(F.col("y"), 2026).alias("year"), surface.year_of_id(F.col("rid"), 2026).cast("long").alias("id_year"))
