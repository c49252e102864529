"""Queries of matching operators on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import aggregates, matching
from weft.plans.tables import registrar, table

QUERIES, SQL, query = registrar()


@query("retraction_exclusion", "select p_partkey, p_size % 4 <> 0 as verified from part where p_size % 4 = 0 or p_size not in (select 1 + s_suppkey % 50 from supplier where s_acctbal < 0 union select 1 + c_custkey % 50 from customer where c_acctbal < -990)")
def retraction_exclusion(spark, sf_dir):
    doi = lambda c: F.concat(F.lit("https://doi.org/10.1234/X"), c.cast("string"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, doi(F.col("p_size"))).alias("d"))
    a = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(doi(1 + F.col("s_suppkey") % 50).alias("doi"))
    b = table(spark, sf_dir, "customer").where("c_acctbal < -990").select(doi(1 + F.col("c_custkey") % 50).alias("doi"))
    return matching.without_retracted(p, "d", [a, b]).select("p_partkey", "verified")


@query("contract_mismatches", """with a as (select o_orderkey, o_orderstatus, o_orderpriority from orders where o_totalprice > 30000), b as (select o_orderkey, case when o_orderpriority = '5-LOW' then 'X' else o_orderstatus end as o_orderstatus, o_orderpriority from orders where o_totalprice < 450000),
    j as (select o_orderkey, a.o_orderstatus as s1, b.o_orderstatus as s2, a.o_orderpriority as p1, b.o_orderpriority as p2 from a full join b using (o_orderkey))
    select o_orderkey, 'o_orderstatus' as field, s1 as now, s2 as "then" from j where s1 is distinct from s2 union all select o_orderkey, 'o_orderpriority', p1, p2 from j where p1 is distinct from p2""")
def contract_mismatches(spark, sf_dir):
    """Orders now, without the smallest, against a frozen copy that lacks the largest and has another status for low priorities."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    frozen = o.where("o_totalprice < 450000").withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.col("o_orderstatus")))
    return matching.contract_mismatches(o.where("o_totalprice > 30000"), frozen, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("framework_engagement", """with f as (select n_name as framework, left(n_name, 2) as anchor from nation), r as (select p_partkey as id, upper(p_name) as m, case when p_size > 30 then 1 when p_size < 10 then -1 else 0 end as sign, p_size % 2 = 0 as prim from part),
    g as (select framework, count(*) filter (where sign > 0 and prim) as pp, count(*) filter (where not (sign > 0 and prim)) as o, count(*) filter (where sign > 0) as u, count(*) filter (where sign < 0) as d, count(*) as n from f join r on contains(m, anchor) group by framework)
    select f.framework, case when n is null then 'insufficient' when pp > 0 and o > 0 then 'extends' when u > d then 'supports' when d > 0 then 'challenges' else 'insufficient' end as status, coalesce(n, 0) as matched from f left join g using (framework)""")
def framework_engagement(spark, sf_dir):
    f = table(spark, sf_dir, "nation").select(F.col("n_name").alias("framework"), F.substring("n_name", 1, 2).alias("anchor"))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("mechanism"), F.when(F.col("p_size") > 30, 1).when(F.col("p_size") < 10, -1).otherwise(0).alias("sign"), (F.col("p_size") % 2 == 0).alias("primary"))
    return matching.framework_engagement(f, r)


@query("mechanism_expansion", "with m as (select p_brand as key, p_type as mechanism from part where p_size < 10) select distinct topic, mechanism from (select s_name as topic, 'Brand#' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1) as domain from supplier) t join m on t.domain = m.key or t.topic = m.key")
def mechanism_expansion(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("topic"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), (F.col("s_nationkey") % 5 + 1).cast("string")).alias("domain"))
    return matching.expand_mechanisms(t, table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_brand").alias("key"), F.col("p_type").alias("mechanism")))


@query("rare_tokens", """with t as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as w from documents), f as (select w from t group by w having count(*) <= 3)
    select doc_id, string_agg(w, ' ' order by w) as tokens from t join f using (w) group by doc_id""")
def rare_tokens(spark, sf_dir):
    r = matching.rare_tokens(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 3)
    return r.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("topic_specific", """with t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents), n as (select n_nationkey, list_distinct(regexp_extract_all(lower(n_name), '[a-z0-9]+')) as k from nation union all select 100 + i, regexp_extract_all(s, '[a-z0-9]+') from (select unnest(range(4)) as i, unnest(['the of inthe', 'und keit', 'que les', 'los zu']) as s))
    select n_nationkey as topic, count(*) filter (where len(list_intersect(w, k)) >= 2 or len(list_intersect(w, k)) >= 0.75 * greatest(len(k), 1)) as fits from t, n group by n_nationkey""")
def topic_specific(spark, sf_dir):
    """Documents that fit each topic: the nations' names and four phrases."""
    n = table(spark, sf_dir, "nation")
    phrases = F.array(*map(F.lit, ("the of inthe", "und keit", "que les", "los zu")))
    extra = n.limit(1).select(F.posexplode(phrases)).select((100 + F.col("pos")).alias("topic"), F.col("col").alias("name"))
    topics = n.select(F.col("n_nationkey").alias("topic"), F.col("n_name").alias("name")).union(extra)
    fits = matching.topic_fits(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), topics, "topic", F.col("name")).groupBy("topic").agg(F.count("*").alias("fits"))
    return topics.select("topic").join(fits, "topic", "left").select("topic", F.coalesce("fits", F.lit(0)).alias("fits"))


@query("unseen_topics", "select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def unseen_topics(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return matching.unseen_topics(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


def aligned_inputs(spark, sf_dir):
    """Turns of a conversation: what users say against what assistants say."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return c.where("role = 'user'").select("conv_id", F.col("k").alias("claim"), "text"), c.where("role <> 'user'").select("conv_id", F.col("k").alias("passage"), "text")


_ALIGN = """t as (select conv_id, conv_id * 1000 + turn as k, role, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) >= 4)) as w, list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) as q from conversations),
    al as (select a.k as claim, b.k as passage, len(list_intersect(a.w, b.w)) as overlap from t a join t b using (conv_id) where a.role = 'user' and b.role <> 'user' and len(list_intersect(a.w, b.w)) >= 3 and len(list_filter(a.q, lambda x: not list_contains(b.q, x))) = 0)"""


@query("claim_alignment", f"with {_ALIGN} select claim, passage, overlap from al")
def claim_alignment(spark, sf_dir):
    return matching.align(*aligned_inputs(spark, sf_dir), "conv_id")


@query("claim_trace_status", f"with {_ALIGN} select conv_id, count(*) as claims, count(*) filter (where k in (select claim from al)) as aligned, count(*) filter (where k in (select claim from al)) >= floor((count(*) * 4 + 4) / 5) as passed from t where role = 'user' group by conv_id")
def claim_trace_status(spark, sf_dir):
    a, b = aligned_inputs(spark, sf_dir)
    return matching.trace_status(a, matching.align(a, b, "conv_id"), "conv_id")


@query("best_source_span", f"with {_ALIGN} select claim, arg_max(passage, (overlap, -passage)) as passage from al group by claim")
def best_source_span(spark, sf_dir):
    return matching.best_span(matching.align(*aligned_inputs(spark, sf_dir), "conv_id"))


@query("capped_evidence_rows", """with a as (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as k from lineitem), b as (select *, row_number() over (partition by l_suppkey, l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as j from a where k <= 4)
    select l_suppkey, l_returnflag, l_orderkey, l_linenumber from b where j <= 1""")
def capped_evidence_rows(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return matching.capped_per_group(table(spark, sf_dir, "lineitem"), [(["l_suppkey"], 4), (["l_suppkey", "l_returnflag"], 1)], order).select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query("soft_filter", "select c_custkey from customer where c_mktsegment = 'BUILDING' or not exists (select 1 from customer where c_mktsegment = 'BUILDING')")
def soft_filter(spark, sf_dir):
    return matching.soft_filter(table(spark, sf_dir, "customer"), F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query("nearest_mark_before", """select e.event_id, e.user_id, cast(m.event_id as varchar) as value from events e asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'signup' group by all) m on e.user_id = m.user_id and e.ts >= m.ts""")
def nearest_mark_before(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    marks = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").cast("string").alias("value"))
    return matching.nearest_before(e, marks, "user_id", "ts")


@query("event_counts_top", "select event_type, count(*) as n from events where value > 10 group by event_type order by n desc, event_type limit 100")
def event_counts_top(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 10")
    return aggregates.histogram(e, ["event_type"]).select(F.col("value").alias("event_type"), "n").orderBy(F.desc("n"), "event_type").limit(100)


@query("key_sides", "select k, 'left' as side from (select distinct s_nationkey as k from supplier where s_acctbal > 9000 except select c_nationkey from customer where c_acctbal > 9900) union all select k, 'right' from (select distinct c_nationkey as k from customer where c_acctbal > 9900 except select s_nationkey from supplier where s_acctbal > 9000)")
def key_sides(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))
    return matching.unmatched(a, table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")), "k")
