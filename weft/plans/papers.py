"""Queries of papers as wholes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import claims, papers
from weft.plans.artifacts import _picked
from weft.plans.outcomes import _values
from weft.plans.synthesis import _RENDERED, _claims_sql, rendered
from weft.plans.tables import registrar, table

QUERIES, SQL, query = registrar()

WORDS = {"pseudo": ["homeopathy"], "out_of_scope": ["crypto"], "contested": ["young blood"], "mainstream": ["statin"], "emerging": ["nmn"]}
#: (name, terms, domain, tier, decision, cap).
TOPICS = [
    ("Homeopathy and statins", [], "biomedical", "pseudo", "stop", 0), ("Returns", ["Crypto trading"], "out_of_scope", "out_of_scope", "stop", 0), ("Young blood", ["nmn"], "biomedical", "contested", "proceed", 150), ("Statins", ["nmn"], "biomedical", "mainstream", "proceed", 500),
    ("NMN", [], "biomedical", "emerging", "proceed", 250), ("Sleep", ["rest"], "biomedical", "adjacent", "proceed", 350),
]


@query("topic_classes", f"with t(k, domain, tier, decision, cap) as (values {_values([(i, *t[2:]) for i, t in enumerate(TOPICS)])}) select o_orderkey as id, domain, tier, decision, cap from orders join t on k = o_orderkey % {len(TOPICS)}")
def topic_classes(spark, sf_dir):
    rows = _picked(spark, sf_dir, [F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, t)).cast("array<string>").alias("terms")) for n, t, *_ in TOPICS])
    return rows.select("id", papers.topic_class(F.col("x.name"), F.col("x.terms"), WORDS).alias("c")).select("id", "c.*")


#: (text, figures).
CAPTIONS = [
    ("Text.\nFigure 1. Mean speed.\nFig. 2b: Rates\nSee Figure 3. in text", [(0, "Figure 1", "Mean speed."), (1, "Figure 2", "b: Rates")]), ("Fig 4. ", [(0, "Figure 4", "")]), ("  Fig 5: x", [(0, "Figure 5", "x")]), ("", []), ("Figures 6. no", []),
    ("FIGURE IV\nNext line", [(0, "Figure IV", "Next line")]),
]


@query("figure_captions", f"with t(k, place, label, caption) as (values {_values([(i, *f) for i, (_, fs) in enumerate(CAPTIONS) for f in fs])}) select o_orderkey as id, place as at, label, caption from orders join t on k = o_orderkey % {len(CAPTIONS)}")
def figure_captions(spark, sf_dir):
    return papers.figures(_picked(spark, sf_dir, [F.lit(t) for t, _ in CAPTIONS]).withColumnRenamed("x", "text"))


@query("claim_artifacts", f"""with {_RENDERED}, {_claims_sql()}, c as (select split_part(id, ':', 1) as paper, kind, count(*) as c from found group by all)
    select paper, cast(sum(c) as bigint) as n, string_agg(kind || '=' || c, ',' order by kind) as counts from c group by paper""")
def claim_artifacts(spark, sf_dir):
    rows = rendered(spark, sf_dir).withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    found = claims.extract(rows, "id", "sentence", spread=spark.sparkContext.defaultParallelism, sentence=False).select(F.split_part("id", F.lit(":"), F.lit(1)).alias("paper"), "kind")
    out = papers.claim_artifacts(found)
    return out.select("paper", "n", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("counts"))


_SOURCES = """s as (select l_orderkey as run, case when l_partkey % 3 = 0 then '10.1000/' || (l_partkey % 40) else '' end as doi, case when l_partkey % 4 = 0 then cast(l_suppkey % 30 + 1 as varchar) else '' end as pmid, case when l_partkey % 5 = 0 then 'PMC' || (l_suppkey % 20) else '' end as pmcid,
        case when l_linenumber % 2 = 0 then '' else cast(2000 + l_partkey % 2 as varchar) end as year, 'title' || (l_partkey % 15) as title, row_number() over () as i from lineitem)"""


@query("sources_unique", f"""with {_SOURCES}, p as (select distinct a.run from s a join s b on a.run = b.run and a.i < b.i
      where not ((a.doi <> '' and b.doi <> '' and a.doi <> b.doi) or (a.pmid <> '' and b.pmid <> '' and a.pmid <> b.pmid) or (a.pmcid <> '' and b.pmcid <> '' and a.pmcid <> b.pmcid))
        and ((a.doi <> '' and a.doi = b.doi) or (a.pmid <> '' and a.pmid = b.pmid) or (a.pmcid <> '' and a.pmcid = b.pmcid) or (a.title = b.title and not (a.year <> '' and b.year <> '' and a.year <> b.year))))
    select distinct run, run not in (select run from p) as "unique" from s""")
def sources_unique(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.when(p % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/"), p % 40)).alias("doi"), F.when(p % 4 == 0, F.concat(F.lit("00"), s % 30 + 1)).alias("pmid"), F.when(p % 5 == 0, F.concat(F.lit("pmc"), s % 20)).alias("pmcid"),
        F.when(F.col("l_linenumber") % 2 > 0, p % 2 + 2000).alias("year"), F.concat(F.lit("Title: "), p % 15).alias("title"),
    )
    return papers.sources_unique(rows, "run")


@query("manifest_rows", "select o_orderkey as run, 'R' || o_custkey as receipt_id, case when o_orderkey % 3 = 0 then 'Cited ' || o_orderkey when o_orderkey % 3 = 1 then 'Lee 2020' else '2020' end as citation_token from orders")
def manifest_rows(spark, sf_dir):
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    rows = o.select(k.alias("run"), F.concat(F.lit("R"), F.col("o_custkey")).alias("receipt_id"), F.when(k % 3 == 1, "Lee ").alias("author"), F.lit(2020).alias("year"))
    registry = o.where(k % 3 == 0).select(k.alias("run"), F.concat(F.lit("R"), F.col("o_custkey")).alias("receipt_id"), F.concat(F.lit("Cited "), k).alias("body_citation"))
    return papers.manifest_rows(rows, registry).select("run", "receipt_id", "citation_token")


@query("created_slugs", "select distinct n_name as slug from nation where n_regionkey < 3")
def created_slugs(spark, sf_dir):
    """Slugs of what refreshes created, from their ledgers' JSON."""
    rows = F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("slug"))).alias("created")))
    ledgers = table(spark, sf_dir, "nation").where("n_regionkey < 3").groupBy("n_regionkey").agg(rows.alias("ledger"))
    made = F.from_json(F.get_json_object("ledger", "$.created"), "array<struct<slug:string>>")
    return ledgers.select(F.explode(made["slug"]).alias("slug")).distinct()
