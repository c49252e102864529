"""Queries of classification, claims, tensions, similarity and audits on the benchmark tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.functions.spans import located_sql, nearest_sql
from weft.operators import audit, claims, classify, similarity, tension
from weft.plans.evidence import _TIER, tier_of
from weft.plans.studies import _cases
from weft.plans.tables import derived, derived_sql, registrar, table

QUERIES, SQL, query = registrar()


# The documents' own syllables stand for the lexicon.
ALIASES = ["thtion", "que", "und"]
LEXICON = {"reject": ["!!", "$$$"], "core": ["tion the", "the of", " der ", "ción"], "mechanism": [" in ", "eaux"], "context": [" of ", " de ", " zu "]}
EXCLUDED = ["with", "schu"]
OUTCOMES = {"mortality": ["heer", "mort"], "glucose": ["shre", "gluc"], "growth": ["inges", "wach"], "function": ["tionth", "keit"], "pain": ["douleur", "pein"]}


def classed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    d = d.withColumn("class", classify.corpus_class(F.col("low"), F.substring("low", 1, 200), ALIASES, LEXICON, EXCLUDED))
    tier = F.get(F.array(*map(F.lit, ("A1", "A2", "B1", "B2", "C", "D1"))), (F.col("doc_id") % 6).cast("int"))
    return d.withColumn("tier", tier).withColumn("pool", classify.extraction_pool(F.col("class"), tier))


def _any(col, terms):
    return "(" + " or ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def _alias(col):
    return "(" + " or ".join(f"regexp_matches({col}, '(^|[^a-z0-9]){a}s?([^a-z0-9]|$)')" for a in ALIASES) + ")"


_CLASSED = f"""d as (select *, lower(text) as low from documents),
    f as (select *, {_alias('low')} as on_, {_alias('left(low, 200)')} as titled, {_any('low', LEXICON['reject'])} as rej, {_any('low', LEXICON['core'])} as core, {_any('low', LEXICON['mechanism'])} as mech, {_any('low', LEXICON['context'])} as ctx, {_any('low', EXCLUDED)} as exc from d),
    c as (select *, case when rej and not on_ then 'reject' when not on_ then 'off_thesis' when not titled and ctx and core then 'adjacent_clinical' when not titled then 'off_thesis' when core and exc then 'adjacent_clinical'
        when core and mech then 'background_mechanism' when core then 'core_on_thesis' when mech then 'background_mechanism' else 'adjacent_clinical' end as class, (['A1', 'A2', 'B1', 'B2', 'C', 'D1'])[doc_id % 6 + 1] as tier from f),
    p as (select *, case class when 'core_on_thesis' then 'core' when 'background_mechanism' then 'background' when 'adjacent_clinical' then 'adjacent' else case when tier in ('A1', 'A2', 'B1') and class <> 'reject' then 'adjacent' end end as pool from c)"""


@query("corpus_classify_5class", f"with {_CLASSED} select doc_id, class, tier, pool from p")
def corpus_classify_5class(spark, sf_dir):
    return classed(spark, sf_dir).select("doc_id", "class", "tier", "pool")


@query("corpus_score", f"""with {_CLASSED} select doc_id, least(100, greatest(0, case class when 'core_on_thesis' then 100 when 'background_mechanism' then 60 when 'adjacent_clinical' then 40 when 'off_thesis' then 20 else 0 end
    + case tier when 'A1' then 30 when 'A2' then 25 when 'B1' then 15 when 'B2' then 10 when 'C' then 5 else 0 end + case lang when 'en' then 20 when 'fr' then 10 else 0 end
    + case when 2026 - (2000 + n_chars % 30) <= 5 then 10 when 2026 - (2000 + n_chars % 30) <= 10 then 5 else 0 end)) as score from p""")
def corpus_score(spark, sf_dir):
    d = classed(spark, sf_dir)
    directness = F.when(F.col("lang") == "en", "direct").when(F.col("lang") == "fr", "indirect")
    return d.select("doc_id", classify.paper_score(F.col("class"), F.col("tier"), directness, 2000 + F.col("n_chars") % 30, 2026).alias("score"))


@query("corpus_funnel", f"""with {_CLASSED}, s as (select count(*) as a, count(*) filter (where pool is not null) as k, count(*) filter (where pool is not null and class not in ('core_on_thesis', 'background_mechanism', 'adjacent_clinical')) as r,
      count(*) filter (where class = 'core_on_thesis') as c1, count(*) filter (where class = 'background_mechanism') as c2, count(*) filter (where class = 'adjacent_clinical') as c3, count(*) filter (where class = 'off_thesis') as c4, count(*) filter (where class = 'reject') as c5,
      count(*) filter (where pool = 'core') as p1, count(*) filter (where pool = 'background') as p2, count(*) filter (where pool = 'adjacent') as p3 from p)
    select unnest(['all', 'kept', 'rescued', 'class:core_on_thesis', 'class:background_mechanism', 'class:adjacent_clinical', 'class:off_thesis', 'class:reject', 'pool:core', 'pool:background', 'pool:adjacent']) as stage, unnest([a, k, r, c1, c2, c3, c4, c5, p1, p2, p3]) as n from s""")
def corpus_funnel(spark, sf_dir):
    return classify.funnel(classed(spark, sf_dir))


@query("outcome_class_first_match", "select doc_id, case " + " ".join(f"when {_any('lower(text)', t)} then '{k}'" for k, t in OUTCOMES.items()) + " else 'other' end as outcome from documents")
def outcome_class_first_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.first_class(F.lower("text"), OUTCOMES).alias("outcome"))


@query("signal_hits", "select doc_id, array_to_string(list_filter([" + ", ".join(f"'{t}'" for v in OUTCOMES.values() for t in v) + "], lambda t: contains(lower(text), t)), ',') as hits from documents")
def signal_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(classify.signals(F.lower("text"), OUTCOMES), ",").alias("hits"))


@query("registry_override_join", """with o as (select n_nationkey as id, n_name as tier, 'direct' as directness from nation where n_nationkey % 2 = 0),
    h as (select c_custkey, min(id) as id from (select c_custkey, unnest([c_nationkey, c_custkey % 50]) as id from customer) join o using (id) group by all)
    select c_custkey as row_id, coalesce(o.tier, c_mktsegment) as tier, coalesce(o.directness, 'indirect') as directness, o.id is not null as overridden from customer left join h using (c_custkey) left join o using (id)""")
def registry_override_join(spark, sf_dir):
    o = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("tier"), F.lit("direct").alias("directness"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 50).alias("ids"), F.col("c_mktsegment").alias("tier"), F.lit("indirect").alias("directness"))
    return classify.override(c, "ids", o, ["tier", "directness"]).drop("ids")


@query("population_gate", """with r as (select c_custkey, case when c_nationkey % 3 = 0 then 'animal' else 'human' end as population, c_acctbal > 5000 as interventional, case when c_nationkey % 2 = 0 then 'core' else 'adjacent' end as pool from customer),
    g as (select count(*) filter (where pool = 'core' and population = 'human') >= 3 and count(*) filter (where pool = 'core' and population = 'human') > count(*) filter (where pool = 'core' and population = 'animal') and count(*) filter (where population <> 'animal' or interventional) >= 20 as d from r)
    select c_custkey, population, interventional, pool from r, g where not d or population <> 'animal' or interventional""")
def population_gate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, "animal").otherwise("human").alias("population"), (F.col("c_acctbal") > 5000).alias("interventional"), F.when(F.col("c_nationkey") % 2 == 0, "core").otherwise("adjacent").alias("pool"))
    return classify.population_gate(c, 20)


def rendered(spark, sf_dir, deal=lambda rows: rows):
    """Result sentences rendered from line items, which `deal` may spread before."""
    k = deal(table(spark, sf_dir, "lineitem"))
    s = F.concat(
        F.lit("Arm "), "l_returnflag", F.lit(" improved by "), F.col("l_quantity").cast("int").cast("string"), F.lit("% (95% CI 0."), F.col("l_linenumber").cast("string"), F.lit(" to 2."), (F.col("l_partkey") % 9).cast("string"),
        F.lit("; p = 0."), F.lpad((F.col("l_linenumber") * 7).cast("string"), 2, "0"), F.lit(", n = "), (F.col("l_partkey") % 90 + 10).cast("string"), F.lit(") after "), (F.col("l_suppkey") % 30 + 1).cast("string"), F.lit(" weeks; mean 4.5 ± 1."), (F.col("l_suppkey") % 10).cast("string"), F.lit(", HR 0.8"), F.col("l_linenumber").cast("string"),
    )
    return k.select("l_orderkey", "l_linenumber", s.alias("sentence"))


_RENDERED = "s as (select l_orderkey, l_linenumber, 'Arm ' || l_returnflag || ' improved by ' || cast(floor(l_quantity) as int) || '% (95% CI 0.' || l_linenumber || ' to 2.' || (l_partkey % 9) || '; p = 0.' || lpad(cast(l_linenumber * 7 as varchar), 2, '0') || ', n = ' || (l_partkey % 90 + 10) || ') after ' || (l_suppkey % 30 + 1) || ' weeks; mean 4.5 ± 1.' || (l_suppkey % 10) || ', HR 0.8' || l_linenumber as sentence from lineitem)"


def one_kind(kind, *groups):
    def run(spark, sf_dir):
        return rendered(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.array_join(claims.found(F.col("sentence"), kind, g), ",").alias(f"v{g}") for g in groups])

    q = claims.KINDS[kind].replace("'", "''")
    cols = ", ".join(f"array_to_string(regexp_extract_all(sentence, '{q}', {g}), ',') as v{g}" for g in groups)
    query(f"claim_extract_{kind}", f"with {_RENDERED} select l_orderkey, l_linenumber, {cols} from s")(run)


for _kind, _groups in (("p_value", (1, 2)), ("ci", (1, 2, 3)), ("n", (1,)), ("percent", (1,)), ("mean_sd", (1, 2)), ("ratio", (1,)), ("unit", (1, 2))):
    one_kind(_kind, *_groups)


def _claims_sql() -> str:
    """claims.extract() for DuckDB: places of every kind, then without those inside an earlier claim."""
    kinds = list(claims.KINDS)
    places = ", ".join(f"{located_sql('sentence', p)} as {k}" for k, p in claims.KINDS.items())
    steps, last = [], "located"
    for i, k in enumerate(kinds):
        earlier = [x for x in kinds[:i] if x in claims.BLOCKING]
        if k in claims.BLOCKED and earlier:
            taken = earlier[0]
            for x in earlier[1:]:
                taken = f"list_concat({taken}, {x})"
            inside = "t.start <= s.start and s.\"end\" <= t.\"end\""
            steps.append(f"{k}_left as (select * replace (list_filter({k}, lambda s: len(list_filter({taken}, lambda t: {inside})) = 0) as {k}) from {last})")
            last = f"{k}_left"
    rows = " union all ".join(
        f"""select id, sentence, '{k}' as kind, s.start as start, s."end" as "end", concat_ws(',', {", ".join(f"regexp_extract(s.match, '{p}', {g + 1})" for g in range(re.compile(p).groups))}) as groups
            from (select id, sentence, unnest({k}) as s from {last})"""
        for k, p in claims.KINDS.items()
    )
    return f"located as (select concat_ws(':', l_orderkey, l_linenumber) as id, sentence, {places} from s), {', '.join(steps)}, found as ({rows})"


ENDPOINTS, ARMS, MOVES = ["mean", "hr"], ["arm a", "arm n", "arm r"], {"improved": "positive", "reduced": "negative"}


def _bound_sql(terms: list[str]) -> str:
    named = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    return f"{named}[{nearest_sql([located_sql('lower(sentence)', rf'\b{t}\b') for t in terms], 'start')} + 1]"


@query("claim_extract_full", f'with {_RENDERED}, {_claims_sql()} select id, kind, start, "end", groups from found')
def claim_extract_full(spark, sf_dir):
    rows = rendered(spark, sf_dir).withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return claims.extract(rows, "id", "sentence", spread=spark.sparkContext.defaultParallelism, sentence=False).withColumn("groups", F.array_join("groups", ","))


@query("endpoint_binding", f"""
    with {_RENDERED}, {_claims_sql()},
    b as (select id, kind, start, {claims.claim_role_sql('sentence', "'results'")} as role, {_bound_sql(ENDPOINTS)} as endpoint, {_bound_sql(ARMS)} as arm, {_bound_sql([*MOVES])} as moved from found)
    select id, kind, start, role, endpoint, arm, case moved when 'improved' then 'positive' when 'reduced' then 'negative' end as direction,
           case when endpoint is not null and arm is not null and moved is not null and role = 'effect' then 'high' when coalesce(endpoint, arm, moved) is not null then 'partial' else 'none' end as confidence
    from b""")
def endpoint_binding(spark, sf_dir):
    """Claims of the rendered sentences bound to their arm and direction."""
    rows = rendered(spark, sf_dir).select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), "sentence", claims.claim_role(F.col("sentence"), F.lit("results")).alias("role"))
    found = claims.extract(rows, "id", "sentence", spread=spark.sparkContext.defaultParallelism, keep=("role",))
    return claims.bind(found.select("id", "kind", "start", "sentence", "role"), ENDPOINTS, ARMS, MOVES).drop("sentence")


#: A word of every list, patterns that overrule, and sections.
ROLES = {
    "sentence": _cases("l_orderkey", [f"It was {w} here" for words in (claims.BACKGROUND_WORDS, claims.EFFECT_WORDS, claims.DURATION_WORDS, claims.DOSE_WORDS, claims.POPULATION_WORDS) for w in words] + [
        "Baseline scores were alike and improved", "Baseline scores improved after care", "A difference in age and sex increased", "Prevalence increased", "Increased dose during the trial", "Nothing said", ""]),
    "section": _cases("l_linenumber", ["introduction", "results", "discussion"]),
}


@query("claim_role", f"select l_orderkey, l_linenumber, {claims.claim_role_sql('sentence', 'section')} as role from {derived_sql('lineitem', ROLES, 'l_orderkey', 'l_linenumber')}")
def claim_role(spark, sf_dir):
    rows = derived(table(spark, sf_dir, "lineitem"), ROLES, "l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", claims.claim_role(F.col("sentence"), F.col("section")).alias("role"))


@query("paper_receipts", """with c as (select l_suppkey as paper, l_orderkey * 10 + l_linenumber as ord, l_partkey % 5 as outcome, 'e' || l_linenumber as endpoint, case when l_tax > 0.04 then 'up' else 'down' end as d, round(l_discount, 2) as p from lineitem),
    n as (select paper, outcome, count(*) as c, min(ord) as f from c group by all), o as (select paper, arg_max(outcome, (c, -f)) as outcome, cast(sum(c) as bigint) as n_claims from n group by paper),
    e as (select paper, endpoint, arg_max(d, ord) as d, min(ord) as o from c group by all), m as (select paper, string_agg(endpoint || '=' || d, ',' order by endpoint) as ends from e group by paper), ps as (select paper, list_aggregate(list_sort(list(distinct p)), 'sum') as s from c group by paper)
    select paper, outcome, n_claims, ends, round(s, 6) as p_sum from o join m using (paper) join ps using (paper)""")
def paper_receipts(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("paper"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_partkey") % 5).alias("outcome"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("endpoint"), F.when(F.col("l_tax") > 0.04, "up").otherwise("down").alias("direction"), F.round("l_discount", 2).alias("p"))
    r = claims.paper_receipts(c)
    ends = F.array_join(F.array_sort(F.transform(F.map_entries("endpoint_directions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return r.select("paper", "outcome", "n_claims", ends.alias("ends"), F.round(F.aggregate("p_values", F.lit(0.0), lambda s, x: s + x), 6).alias("p_sum"))


_RECEIPT = {
    "id": "s_suppkey", "outcome": "s_suppkey % 4", "directness": "case when s_suppkey % 5 < 3 then 'direct' else 'indirect' end",
    "e": "concat('e', cast(s_suppkey % 3 as string))", "d": "case when s_acctbal > 3000 then 'positive' when s_acctbal < 0 then 'negative' else 'null' end",
    "f": "concat('f', cast(s_suppkey % 2 as string))", "g": "case when s_suppkey % 7 < 3 then 'positive' when s_suppkey % 7 < 5 then 'negative' else 'mixed' end",
}


def receipts(spark, sf_dir):
    """Suppliers as receipts with directions of two endpoints, regions as topics."""
    s = derived(table(spark, sf_dir, "supplier"), _RECEIPT, "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("topic"))
    said = F.array(*[F.struct(F.col(k).alias("endpoint"), F.col(v).alias("direction")) for k, v in (("e", "d"), ("f", "g"))])
    none = F.lit(None).cast("string")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("id", "topic", "outcome", "directness", tension.endpoint_map(said, F.array(none), none).alias("endpoint_directions"))


def _kind_sql(a: str, b: str) -> str:
    return f"""case when [{a}, {b}] in (['positive', 'negative'], ['negative', 'positive']) then 'disagreement' when [{a}, {b}] in (['null', 'positive'], ['positive', 'null']) then 'null_vs_positive'
      when [{a}, {b}] in (['null', 'negative'], ['negative', 'null']) then 'null_vs_negative' when {a} = {b} and {a} in ('positive', 'negative') then 'agreement' else 'orthogonal' end"""


def _severity_sql(k: str) -> str:
    return f"case coalesce({k}, 'orthogonal') when 'orthogonal' then 0 when 'agreement' then 2 when 'indirectness_gap' then 3 when 'mechanism_vs_clinical' then 3 when 'disagreement' then 5 else 4 end"


_PAIRS = f"""r as (select *, n_regionkey as topic from {derived_sql("supplier", _RECEIPT, "s_nationkey")} join nation on s_nationkey = n_nationkey),
    m as (select a.topic, a.id as a, b.id as b, a.outcome = b.outcome as same, a.directness as x, b.directness as y, a.e, a.f, case when a.e = b.e then {_kind_sql("a.d", "b.d")} end as k1, case when a.f = b.f then {_kind_sql("a.g", "b.g")} end as k2
      from r a join r b on a.topic = b.topic and a.id < b.id),
    s as (select *, case when {_severity_sql("k1")} = 0 and {_severity_sql("k2")} = 0 then null when {_severity_sql("k1")} >= {_severity_sql("k2")} then 1 else 2 end as w from m),
    t as (select topic, a, b, case when x <> y then case when same then 'indirectness_gap' else 'mechanism_vs_clinical' end when not same or x <> 'direct' or w is null then 'orthogonal' when w = 1 then k1 else k2 end as kind,
      case when same and x = 'direct' and y = 'direct' then case w when 1 then e when 2 then f end end as endpoint from s),
    v as (select *, {_severity_sql("kind")} as severity from t)"""


@query("tension_pairs", f"with {_PAIRS} select topic, a, b, kind, endpoint, severity from v")
def tension_pairs(spark, sf_dir):
    return tension.pairs(receipts(spark, sf_dir), "topic")


@query("tension_severity", f"with {_PAIRS} select topic, kind, count(*) as n, max(severity) as severity from v group by all")
def tension_severity(spark, sf_dir):
    return tension.severity(receipts(spark, sf_dir), "topic")


@query("tension_weight", f"""select o_orderkey, case left({_TIER}, 1) when 'A' then 3.0 when 'B' then 2.0 when 'C' then 1.0 else 0.0 end + case o_orderstatus when 'F' then 2.0 when 'O' then 1.0 else 0.5 end as weight from orders""")
def tension_weight(spark, sf_dir):
    d = F.when(F.col("o_orderstatus") == "F", "direct").when(F.col("o_orderstatus") == "O", "indirect").otherwise("mechanistic")
    return table(spark, sf_dir, "orders").select("o_orderkey", tension.weight(tier_of("o_orderkey"), d).alias("weight"))


@query("tension_top_capped", f"""with recursive {_PAIRS}, g as (select 0 as step, cast([] as bigint[]) as used, cast(null as bigint) as topic, cast(null as bigint) as a, cast(null as bigint) as b, cast(null as varchar) as kind, cast(null as varchar) as endpoint, 0 as severity
    union all (select g.step + 1, list_concat(g.used, [v.a, v.b]), v.topic, v.a, v.b, v.kind, v.endpoint, v.severity from g, v where g.step < 10 and not list_contains(g.used, v.a) and not list_contains(g.used, v.b) order by v.severity desc, v.a, v.b limit 1))
    select topic, a, b, kind, endpoint, severity, printf('T%03d', step) as tension_id from g where step > 0""")
def tension_top_capped(spark, sf_dir):
    """The ten severest tensions, each supplier in one at most."""
    p = tension.top_capped(receipts(spark, sf_dir), "topic", 10).withColumn("rank", F.struct(-F.col("severity"), "a", "b"))
    return tension.plan(p, "rank").drop("rank")


@query("tension_diverse_cosine")
def tension_diverse_cosine(spark, sf_dir):
    return tension.diverse(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("cosine_search", """with u as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)
    select q.vec_id as query, m.vec_id as match, round(list_cosine_similarity(q.v, m.v), 6) as cosine from u q join u m on q.vec_id <> m.vec_id where q.vec_id % 100 = 0 and list_cosine_similarity(q.v, m.v) >= 0.3""")
def cosine_search(spark, sf_dir):
    """Every vector whose id is divisible by 100 against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return similarity.cosine_search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 0.3).select("query", "match", F.round("cosine", 6).alias("cosine"))


_SETS = """select id, list_sort(list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+'))) as t from"""
_LINES = "(select distinct md5(line) as id, line as x from (select unnest(string_split(coalesce(text, ''), chr(10))) as line from documents))"


def _near_sql(rows: str, limit: float, least: int) -> str:
    return f"""with s as ({_SETS} {rows}), r as (select t, min(id) as id from s where len(t) >= {least} group by t),
    p as (select a.id as a, b.id as b, len(a.t) + len(b.t) as n, len(list_intersect(a.t, b.t)) as k from r a join r b on a.id < b.id and len(a.t) >= {limit} * len(b.t) and len(b.t) >= {limit} * len(a.t))
    select a, b, round(k / (n - k), 6) as similarity from p where k >= {limit} * (n - k)"""


@query("near_duplicate_docs", _near_sql("(select doc_id as id, text as x from documents)", 0.9, 1))
def near_duplicate_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return similarity.similar_sets(d, "doc_id", "t", 0.9, 1).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("near_duplicate_members", f"""with s as ({_SETS} (select doc_id as id, text as x from documents)), r as (select t, min(id) as representative from s where len(t) >= 1 group by t) select id, representative from s join r using (t)""")
def near_duplicate_members(spark, sf_dir):
    return similarity.members(table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t")), "doc_id", "t", 1)


@query("near_duplicate_lines", _near_sql(_LINES, 0.9, 1))
def near_duplicate_lines(spark, sf_dir):
    return similarity.near_duplicate_lines(table(spark, sf_dir, "documents"), "doc_id", "text", least=1).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("near_duplicate_line_members", f"""with s as ({_SETS} {_LINES}), r as (select t, min(id) as representative from s where len(t) >= 1 group by t), o as (select distinct doc_id, md5(line) as id from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents))
    select doc_id, id as line_id, representative from o join s using (id) join r using (t)""")
def near_duplicate_line_members(spark, sf_dir):
    return similarity.line_members(table(spark, sf_dir, "documents"), "doc_id", "text", least=1)


_NUMBERS = r"regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?')"


@query("text_numbers", rf"select distinct doc_id as id, replace(n, ',', '') as number from (select doc_id, unnest({_NUMBERS}) as n from documents)")
def text_numbers(spark, sf_dir):
    return audit.numbers(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("numeric_traceability", rf"""with p as (select distinct doc_id as id, replace(n, ',', '') as number from (select doc_id, unnest({_NUMBERS}) as n from documents)),
    k as (select distinct replace(n, ',', '') as number from (select unnest({_NUMBERS}) as n from conversations))
    select id, count(*) as numbers, count(k.number) as traced, round(count(k.number) / count(*), 6) as coverage from p left join k using (number) group by id""")
def numeric_traceability(spark, sf_dir):
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    return audit.traceability(audit.numbers(d, "doc_id", "text"), audit.numbers(c, "conv_id", "text"))


@query("numeric_density", r"select doc_id, round(len(regexp_extract_all(text, '[0-9]+')) * 1000.0 / greatest(len(list_filter(string_split_regex(text, '[ \t\n\r\f\x0b]+'), lambda w: w <> '')), 1), 1) as density from documents")
def numeric_density(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.per_thousand_words(F.col("text"), "[0-9]+").alias("density"))


PHRASES = {"the the": "P1", "of and": "P2", "de la": "P2", "!!": "P1"}


@query("template_hits", """with l as (select conv_id * 1000 + turn as id, unnest(string_split(lower(text), chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from conversations),
    p as (select unnest(['the the', 'of and', 'de la', '!!']) as phrase, unnest(['P1', 'P2', 'P2', 'P1']) as level) select id, line, phrase, level from l join p on contains(t, phrase)""")
def template_hits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return audit.denylist_hits(c, "id", "text", PHRASES)


@query("adjacent_duplicate_words", "with w as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents) select doc_id as id, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as repeats from w")
def adjacent_duplicate_words(spark, sf_dir):
    return audit.repeated_words(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("identity_hash", "select p_partkey, sha256(p_brand || chr(31) || p_type || chr(31) || p_size) as identity_sha256 from part")
def identity_hash(spark, sf_dir):
    return audit.identity_hash(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"]).select("p_partkey", "identity_sha256")


@query("rows_fingerprint", """with h as (select o_orderstatus, md5(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderpriority || chr(31)) as h from orders),
    s as (select o_orderstatus, count(*) as n, bit_xor(cast('0x' || left(h, 15) as bigint)) as x, cast(sum(cast('0x' || right(h, 15) as bigint) % 1000003) as bigint) as s from h group by 1) select o_orderstatus, n, sha256(n || '|' || x || '|' || s) as digest from s""")
def rows_fingerprint(spark, sf_dir):
    return audit.fingerprint(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("citation_mismatch", "select distinct 'c' || c_nationkey * 3 as label, 'unreferenced' as problem from customer where 'c' || c_nationkey * 3 not in (select 'c' || s_suppkey from supplier) union all select distinct 'c' || s_suppkey, 'orphan' from supplier where 'c' || s_suppkey not in (select 'c' || c_nationkey * 3 from customer)")
def citation_mismatch(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), (F.col("c_nationkey") * 3).cast("string")).alias("label"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("label"))
    return audit.label_mismatch(c, s)
