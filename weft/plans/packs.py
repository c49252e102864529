"""Queries of audit packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import auditpack
from weft.plans.artifacts import _picked
from weft.plans.outcomes import _values
from weft.plans.tables import registrar, table

QUERIES, SQL, query = registrar()


def _registry(spark, sf_dir):
    """Line items as references of their orders; some without identifiers, DOIs written in three ways."""
    p = F.col("l_partkey")
    doi = F.when(p % 6 == 0, None).when(p % 6 == 1, F.concat(F.lit(" https://doi.org/10.1/P"), p)).when(p % 6 == 2, F.concat(F.lit("doi.org/10.1/p"), p)).otherwise(F.concat(F.lit("10.1/p"), p))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("reference_id"), p.alias("part"), doi.alias("doi"), F.when(p % 18 > 0, "1").otherwise(" ").alias("pmid"), F.lit(None).cast("string").alias("pmcid"))


def _retracted(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 97 = 5").select(F.concat(F.lit("10.1/P"), F.col("p_partkey")).alias("doi"))


_REFS = "refs as (select l_orderkey as run, l_linenumber as reference_id, l_partkey as part, l_partkey % 18 > 0 as resolved, l_partkey % 6 > 0 and l_partkey % 97 = 5 and l_partkey in (select p_partkey from part) as retracted from lineitem)"


@query("pack_references", f"with {_REFS} select * from refs")
def pack_references(spark, sf_dir):
    return auditpack.references(_registry(spark, sf_dir), _retracted(spark, sf_dir)).select("run", "reference_id", "part", "resolved", "retracted")


@query("ship_recommendations", f"""with {_REFS}, c as (select run, count(*) filter (where retracted) as bad, count(*) filter (where not resolved) as open from refs group by run)
    select o_orderkey as run, case when bad > 0 then 'BLOCK — cites a retracted source' when open > 0 then 'BLOCK — unresolved references' when o_orderkey % 5 = 0 then 'BLOCK — retraction check unavailable'
      when case o_orderkey % 3 when 0 then o_orderkey % 2 > 0 when 1 then false else true end = false then 'BLOCK — unresolved P1 / not all-green' when o_orderkey % 2 > 0 and o_orderkey % 7 > 0 then 'SHIP — all gates green and journal-ready' else 'CAVEAT — below journal-ready bar; human review advised' end as advice
    from orders left join c on run = o_orderkey""")
def ship_recommendations(spark, sf_dir):
    k = F.col("o_orderkey")
    verdicts = table(spark, sf_dir, "orders").select(k.alias("run"), F.when(k % 3 > 0, k % 3 == 2).alias("p1_clean"), (k % 2 > 0).alias("all_green"), (k % 7 > 0).alias("journal_ready"), F.when(k % 5 > 0, True).alias("checked"))
    return auditpack.ship_recommendation(verdicts, auditpack.references(_registry(spark, sf_dir), _retracted(spark, sf_dir)))


def _assessed(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("ord"), F.concat(F.lit("Cite "), k).alias("citation_token"), F.lit("").alias("paper_id"), F.concat(F.lit("R"), k).alias("receipt_id"), F.when(k % 4 > 0, F.concat(F.lit("O"), F.col("o_custkey") % 30)).alias("outcome"),
        F.when(k % 3 == 0, F.concat(F.lit(" cite "), k)).when(k % 3 == 1, F.concat(F.lit("r"), k + k % 2)).alias("rob_study"), F.when(k % 5 == 0, "Other").otherwise(F.concat(F.lit("o"), F.col("o_custkey") % 31)).alias("grade_outcome"),
    )


@query("bias_payloads", "select o_orderkey as ord from orders where o_orderkey % 3 = 0 or (o_orderkey % 3 = 1 and o_orderkey % 2 = 0)")
def bias_payloads(spark, sf_dir):
    return auditpack.quality_payloads(_assessed(spark, sf_dir))[0].select("ord")


@query("grade_payloads", """with a as (select o_orderkey as ord, case when o_orderkey % 4 > 0 then 'o' || (o_custkey % 30) else 'other' end as key, case when o_orderkey % 5 = 0 then 'other' else 'o' || (o_custkey % 31) end as said from orders)
    select key, min(ord) as ord from a where key = said group by key""")
def grade_payloads(spark, sf_dir):
    return auditpack.quality_payloads(_assessed(spark, sf_dir))[1].select("key", "ord")


@query("understated_bias", """with d as (select l_orderkey as study, max(l_linenumber % 3) as w from lineitem group by l_orderkey)
    select study, ['low', 'some concerns', 'high'][o_custkey % 3 + 1] as stated, ['low', 'some concerns', 'high'][w + 1] as worst from d join orders on o_orderkey = study where o_custkey % 3 < w""")
def understated_bias(spark, sf_dir):
    scale = ["low", "some concerns", "high"]
    of = lambda c: F.get(F.array(*map(F.lit, scale)), (F.col(c) % 3).cast("int"))
    domains = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("study"), of("l_linenumber").alias("rating"))
    return auditpack.understated(domains, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study"), of("o_custkey").alias("stated")), scale)


_PAPER = '{"agentId": "v3", "artifactType": "research_paper", "decision": "Accept", "published": true, '
#: (payload, rows in it, public papers among them, latest time).
PAYLOADS = [
    ('[{"published_at": "2026-01-02T03:04:05Z"}, 7, {"createdAt": "2026-02-01"}]', 2, 0, "2026-02-01 00:00:00"), ('{"items": [' + _PAPER + '"createdAt": "2026-03-01T10:00:00+02:00"}]}', 1, 1, "2026-03-01 08:00:00"),
    ('{"n": 2, "papers": [{"publishedAt": "soon", "updated_at": "2026-04-01 05:06:07"}]}', 1, 0, "2026-04-01 05:06:07"), ('{"n": 2}', 0, 0, None), ("not JSON", 0, 0, None), ("", 0, 0, None), ('{"data": []}', 0, 0, None),
    ('{"rows": [' + _PAPER.replace("Accept", "revise") + '"x": 1}, ' + _PAPER.replace("v3", "v2") + '"x": 1}, ' + _PAPER.replace("true", "false") + '"public_visible": true}]}', 3, 1, None),
]


@query("publication_payloads", f"with t(k, n, public, latest) as (values {_values([(i, *p[1:]) for i, p in enumerate(PAYLOADS)])}) select o_orderkey as id, n, public, latest from orders join t on k = o_orderkey % {len(PAYLOADS)}")
def publication_payloads(spark, sf_dir):
    rows = _picked(spark, sf_dir, [F.lit(p) for p, *_ in PAYLOADS]).select("id", F.explode_outer(auditpack.payload_rows(F.col("x"))).alias("row"))
    latest = auditpack.latest_publication(rows, "id", "row").select("id", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))
    counts = rows.groupBy("id").agg(F.count("row").cast("int").alias("n"), F.count_if(auditpack.is_public_paper(F.col("row"), ["v3"])).cast("int").alias("public"))
    return counts.join(latest, "id")


@query("source_inventory", "select o_custkey as topic, count(*) as enabled, count(*) filter (where o_orderstatus = 'F') as succeeded, count(*) filter (where o_orderstatus = 'P') as failed, count(*) filter (where o_orderstatus = 'O') as pending from orders group by o_custkey")
def source_inventory(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").otherwise("enabled")
    return auditpack.source_inventory(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("topic"), F.col("o_orderkey").alias("source"), status.alias("status")), "topic")


@query("retrieval_exclusions", "select l_suppkey as topic, case when l_linenumber % 3 = 0 then 'Reason not recorded' else 'off topic ' || (l_linenumber % 3) end as reason, count(*) as n from lineitem where l_partkey % 4 = 0 group by all")
def retrieval_exclusions(spark, sf_dir):
    keep = F.when(F.col("l_partkey") % 4 == 0, False).when(F.col("l_partkey") % 4 == 1, True)
    reason = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("off topic "), F.col("l_linenumber") % 3))
    return auditpack.exclusion_reasons(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("topic"), keep.alias("keep_for_extraction"), reason.alias("reason")), "topic")


@query("domain_frameworks", """with o as (select o_custkey, list(case o_orderkey % 4 when 0 then 'Frailty' when 1 then 'safety' else 'other' end order by o_orderkey)[1:2] as first from orders group by o_custkey)
    select o_custkey as topic, case when o_custkey % 11 = 0 or list_contains(first, 'Frailty') then 'ageing' when list_contains(first, 'safety') then 'harms' else 'general' end as framework from o""")
def domain_frameworks(spark, sf_dir):
    """Each customer's first two orders give outcomes; every eleventh topic says what it is by its class."""
    kind = F.get(F.array(*map(F.lit, ("Frailty", "safety", "other", "other"))), (F.col("o_orderkey") % 4).cast("int"))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", kind.alias("k")))), lambda x: x["k"]).alias("outcomes"))
    frameworks = [("ageing", ["frailty", "lifespan"]), ("harms", ["safety"]), ("general", [])]
    return g.select(F.col("o_custkey").alias("topic"), auditpack.framework_of(F.lit("Agent"), F.when(F.col("o_custkey") % 11 == 0, "Lifespan"), F.col("outcomes"), frameworks, 2).alias("framework"))
