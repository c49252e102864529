"""Queries of effects, records and receipts on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import clean_text, dedupe_key, identity_keys, normalize_doi, title_signature
from weft.operators import aggregates, identity, meta
from weft.plans.tables import registrar, table

QUERIES, SQL, query = registrar()


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per priority and supplier, returned against normal lines: mean difference of price."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = line.where(F.col("l_returnflag").isin("R", "N")).join(orders, line.l_orderkey == orders.o_orderkey)
    t = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))
    c = F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice"))
    s = rows.groupBy("o_orderpriority", "l_suppkey").agg(
        F.avg(t).alias("mt"), F.stddev_samp(t).alias("st"), F.count(t).alias("nt"), F.avg(c).alias("mc"), F.stddev_samp(c).alias("sc"), F.count(c).alias("nc")
    )
    effect, se = meta.mean_difference(*(F.col(k) for k in ("mt", "st", "nt", "mc", "sc", "nc")))
    return s.where("nt >= 2 and nc >= 2").select("o_orderpriority", "l_suppkey", effect.alias("effect"), se.alias("se")).where("se > 0")


_ARMS = """
    a as (select o_orderpriority, l_suppkey,
            avg(l_extendedprice) filter (where l_returnflag = 'R') as mt, stddev_samp(l_extendedprice) filter (where l_returnflag = 'R') as st, count(*) filter (where l_returnflag = 'R') as nt,
            avg(l_extendedprice) filter (where l_returnflag = 'N') as mc, stddev_samp(l_extendedprice) filter (where l_returnflag = 'N') as sc, count(*) filter (where l_returnflag = 'N') as nc
          from lineitem join orders on l_orderkey = o_orderkey group by all),
    e as (select o_orderpriority, l_suppkey, mt - mc as effect, sqrt(st * st / nt + sc * sc / nc) as se from a where nt >= 2 and nc >= 2 and sqrt(st * st / nt + sc * sc / nc) > 0),
    f as (select o_orderpriority, count(*) as k, sum(1 / (se * se)) as sw, sum(1 / (se * se) / (se * se)) as sww, sum(effect / (se * se)) / sum(1 / (se * se)) as fx from e group by all having count(*) >= 3),
    q as (select o_orderpriority, sum((effect - fx) ** 2 / (se * se)) as q from e join f using (o_orderpriority) group by all),
    s as (select o_orderpriority, k, sw, fx, q, case when q > 0 then greatest(0, (q - (k - 1)) / q) else 0 end as i2,
            case when sw - sww / sw > 0 then greatest(0, (q - (k - 1)) / (sw - sww / sw)) else 0 end as tau2 from f join q using (o_orderpriority))"""
_ROUND = "round(estimate, 4) as estimate, round(se, 4) as se, round(estimate - 1.959963984540054 * se, 4) as ci_low, round(estimate + 1.959963984540054 * se, 4) as ci_high, round(q, 4) as q, round(i2, 6) as i2"


def rounded(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, "k", *[F.round(c, 4).alias(c) for c in ("estimate", "se", "ci_low", "ci_high", "q")], F.round("i2", 6).alias("i2"), F.round("tau2", 2).alias("tau2"))


@query("meta_pool_random_effects", f"""with {_ARMS},
    w as (select o_orderpriority, k, q, i2, tau2, sum(effect / (se * se + tau2)) / sum(1 / (se * se + tau2)) as estimate, sqrt(1 / sum(1 / (se * se + tau2))) as se
          from e join s using (o_orderpriority) group by all)
    select o_orderpriority, k, {_ROUND}, round(tau2, 2) as tau2 from w""")
def meta_pool_random_effects(spark, sf_dir):
    return rounded(meta.pool(arms(spark, sf_dir), ["o_orderpriority"]), "o_orderpriority")


@query("meta_pool_fixed_effect", f"""with {_ARMS}, w as (select o_orderpriority, k, q, i2, fx as estimate, sqrt(1 / sw) as se from s)
    select o_orderpriority, k, {_ROUND}, 0.0 as tau2 from w""")
def meta_pool_fixed_effect(spark, sf_dir):
    return rounded(meta.pool(arms(spark, sf_dir), ["o_orderpriority"], model="fixed"), "o_orderpriority")


@query("meta_pool_quick", f"""with {_ARMS}, n as (select n_name, effect, se, s_acctbal < -900 as high from e join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
    g as (select n_name, count(*) as k, bool_or(high) as closed, sum(effect / (se * se)) / sum(1 / (se * se)) as est, sqrt(1 / sum(1 / (se * se))) as s from n group by all)
    select n_name, k, case when closed then 'closed: high risk of bias' when k < 2 then 'skipped: too few studies' else 'pooled' end as status,
      case when not closed and k >= 2 then round(est, 4) end as estimate, case when not closed and k >= 2 then round(est - 1.96 * s, 4) end as ci_low, case when not closed and k >= 2 then round(est + 1.96 * s, 4) end as ci_high from g""")
def meta_pool_quick(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = arms(spark, sf_dir).join(s, F.col("l_suppkey") == s.s_suppkey).join(n, F.col("s_nationkey") == n.n_nationkey)
    out = meta.pool_quick(rows, ["n_name"], F.col("s_acctbal") < -900)
    return out.select("n_name", "k", "status", *[F.round(c, 4).alias(c) for c in ("estimate", "ci_low", "ci_high")])


def binary_arms(spark, sf_dir):
    """Finished orders by nation, of customers in debt against the others."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    t, e = F.col("c_acctbal") < 0, F.col("o_orderstatus") == "F"
    return rows.groupBy("c_nationkey").agg(F.count_if(t & e).alias("a"), F.count_if(t).alias("n_t"), F.count_if(~t & e).alias("c"), F.count_if(~t).alias("n_c"))


_BINARY = "b as (select c_nationkey, count(*) filter (where c_acctbal < 0 and o_orderstatus = 'F') as a, count(*) filter (where c_acctbal < 0) as n_t, count(*) filter (where c_acctbal >= 0 and o_orderstatus = 'F') as c, count(*) filter (where c_acctbal >= 0) as n_c from orders join customer on o_custkey = c_custkey group by all)"


@query("effect_log_rr", f"""with {_BINARY} select c_nationkey, case when a > 0 and c > 0 and a < n_t and c < n_c then round(ln((a / n_t) / (c / n_c)), 9) end as effect,
    case when a > 0 and c > 0 and a < n_t and c < n_c then round(sqrt(1 / a - 1 / n_t + 1 / c - 1 / n_c), 9) end as se from b""")
def effect_log_rr(spark, sf_dir):
    e, s = meta.log_risk_ratio(*(F.col(k) for k in ("a", "n_t", "c", "n_c")))
    return binary_arms(spark, sf_dir).select("c_nationkey", F.round(e, 9).alias("effect"), F.round(s, 9).alias("se"))


@query("effect_log_or", f"""with {_BINARY}, ok as (select *, a > 0 and c > 0 and a < n_t and c < n_c as ok from b)
    select c_nationkey, case when ok then round(ln(a * (n_c - c) / ((n_t - a) * c)), 9) end as effect, case when ok then round(sqrt(1 / a + 1 / (n_t - a) + 1 / c + 1 / (n_c - c)), 9) end as se from ok""")
def effect_log_or(spark, sf_dir):
    e, s = meta.log_odds_ratio(*(F.col(k) for k in ("a", "n_t", "c", "n_c")))
    return binary_arms(spark, sf_dir).select("c_nationkey", F.round(e, 9).alias("effect"), F.round(s, 9).alias("se"))


@query("effect_log_hr", """with h as (select l_suppkey, avg(l_quantity) / 25 as hr, avg(l_quantity) / 25 * 0.8 as lo, avg(l_quantity) / 25 * (1.1 + avg(l_discount)) as hi from lineitem group by all)
    select l_suppkey, round(ln(hr), 9) as effect, round((ln(hi) - ln(lo)) / (2 * 1.959963984540054), 9) as se from h""")
def effect_log_hr(spark, sf_dir):
    hr = F.avg("l_quantity") / 25
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(hr.alias("hr"), (hr * 0.8).alias("lo"), (hr * (1.1 + F.avg("l_discount"))).alias("hi"))
    e, s = meta.log_hazard_ratio(F.col("hr"), F.col("lo"), F.col("hi"))
    return rows.select("l_suppkey", F.round(e, 9).alias("effect"), F.round(s, 9).alias("se"))


@query("effect_shape_dispatch", """with r as (select p_partkey, case when p_size % 5 = 0 then p_retailprice / 1000 end as effect, case when p_size % 5 in (0, 1) then 0.1 + p_size / 100 end as se,
      case when p_size % 5 in (2, 3) then p_size + 2.0 end as hr, case when p_size % 5 = 2 or p_size % 7 = 3 then 1.0 end as lo, case when p_size % 5 in (2, 3) then p_size + 4.0 end as hi from part),
    s as (select *, (effect is not null and se is not null)::int + (hr is not null and lo is not null and hi is not null)::int as n from r),
    t as (select *, case when n > 1 then 'ambiguous' when n = 0 then 'unknown' when effect is not null and se is not null then 'effect' else 'hazard' end as shape from s)
    select p_partkey, shape, round(case when shape = 'effect' then effect when shape = 'hazard' then ln(hr) end, 9) as effect_size, round(case when shape = 'effect' then se when shape = 'hazard' then (ln(hi) - ln(lo)) / (2 * 1.959963984540054) end, 9) as effect_se,
      case when shape = 'effect' then 'smd' when shape = 'hazard' then 'log_hr' end as metric_out, case when shape in ('ambiguous', 'unknown') then shape || ' shape' end as error from t""")
def effect_shape_dispatch(spark, sf_dir):
    m5 = F.col("p_size") % 5
    raw = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(m5 == 0, F.col("p_retailprice") / 1000).alias("effect"), F.when(m5.isin(0, 1), 0.1 + F.col("p_size") / 100).alias("se"),
        F.when(m5.isin(2, 3), F.col("p_size") + 2.0).alias("hr"), F.when((m5 == 2) | (F.col("p_size") % 7 == 3), 1.0).alias("ci_lower"), F.when(m5.isin(2, 3), F.col("p_size") + 4.0).alias("ci_upper"),
        F.lit("smd").alias("metric"), *[F.lit(None).cast("double").alias(c) for c in ("mean_t", "sd_t", "n_t", "mean_c", "sd_c", "n_c", "events_t", "events_c")],
    )
    return meta.normalize_effects(raw).select("p_partkey", "shape", F.round("effect_size", 9).alias("effect_size"), F.round("effect_se", 9).alias("effect_se"), "metric_out", "error")


def record_hits(spark, sf_dir):
    """Documents, pages and benchmark items as bibliographic hits."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.lit("documents").alias("source"), F.substring("text", 1, 80).alias("title"), F.substring("text", 1, 300).alias("abstract"),
        F.when(F.col("n_chars") % 3 == 0, (F.col("n_chars") % 50 + 1970)).cast("long").alias("year"), F.lit(None).cast("string").alias("url"))
    p = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 10_000_000).alias("ord"), F.lit("pages").alias("source"), F.regexp_extract("url", "://([^/]*)", 1).alias("title"), F.lit("").alias("abstract"),
        F.lit(None).cast("long").alias("year"), F.col("url"))
    b = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 20_000_000).alias("ord"), F.lit("benchmark").alias("source"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"),
        F.lit(2000).cast("long").alias("year"), F.lit(None).cast("string").alias("url"))
    none = F.lit(None).cast("string")
    return d.unionByName(p).unionByName(b).withColumn("key", dedupe_key(none, none, none, F.col("title")))


_HITS = """h as (select doc_id as ord, 'documents' as source, left(text, 80) as title, left(text, 300) as abstract, case when n_chars % 3 = 0 then n_chars % 50 + 1970 end as year, null as url from documents
    union all select page_id + 10000000, 'pages', regexp_extract(url, '://([^/]*)', 1), '', null, url from pages
    union all select item_id + 20000000, 'benchmark', left(text, 80), text, 2000, null from benchmark),
    k as (select *, 'title:' || left(lower(title), 80) as key from h)"""


@query("hit_merge", f"""with {_HITS} select key, arg_max(nullif(abstract, ''), (length(abstract), -ord)) as abstract, arg_max(nullif(title, ''), (length(title), -ord)) as title,
    cast(arg_min(year, ord) filter (where year is not null) as bigint) as year, arg_min(url, ord) filter (where url is not null) as url, array_to_string(list_sort(list(distinct source)), ',') as sources, count(distinct source) as n_sources from k group by key""")
def hit_merge(spark, sf_dir):
    return identity.merge_hits(record_hits(spark, sf_dir)).select("key", "abstract", "title", "year", "url", F.array_join("sources", ",").alias("sources"), F.col("n_sources").cast("long").alias("n_sources"))


@query("wave_first_touch", """with h as (select lang as wave, doc_id as ord, left(lower(text), 80) as key from documents),
    f as (select key, arg_min(wave, (wave, ord)) as wave from h group by key), n as (select wave, count(*) as new from f group by wave), s as (select wave, count(distinct key) as keys from h group by wave)
    select wave, coalesce(new, 0) as new, keys - coalesce(new, 0) as seen_before, cast(sum(coalesce(new, 0)) over (order by wave) as bigint) as total from s left join n using (wave)""")
def wave_first_touch(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("wave"), F.col("doc_id").alias("ord"), F.substring(F.lower("text"), 1, 80).alias("key"))
    return identity.accumulate_waves(d)


@query("identity_keys", r"""select p_partkey, array_to_string(case when len(k) > 0 then k else list_filter(['title:' || nullif(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), '')], lambda x: x is not null) end, ' ') as keys from (
    select p_partkey, p_name, list_sort(list_filter([case when p_size % 4 = 0 then 'doi:10.1000/' || p_size end, case when p_size % 3 = 0 then 'pmid:' || coalesce(nullif(ltrim(lpad(cast(p_size as varchar), 8, '0'), '0'), ''), '0') end], lambda x: x is not null)) as k from part)""")
def identity_keys_(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("doi", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("10.1000/"), F.col("p_size").cast("string")))).withColumn("pmid", F.when(F.col("p_size") % 3 == 0, F.lpad(F.col("p_size").cast("string"), 8, "0")))
    keys = identity_keys(F.col("doi"), F.col("pmid"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("p_name"))
    return p.select("p_partkey", F.array_join(F.array_sort(keys), " ").alias("keys"))


# Row by row, with what the kept ones hold.
@query("identity_dedup_greedy", r"""with recursive k as (select row_number() over (order by doc_id) as n, doc_id, ['t:' || regexp_replace(lower(left(text, 80)), '[^a-z0-9]+', '', 'g'), 'n:' || n_chars || ':' || source] as keys from documents),
    g as (select cast(0 as bigint) as n, cast(0 as bigint) as doc_id, cast([] as varchar[]) as used, false as kept
      union all select k.n, k.doc_id, case when list_has_any(used, keys) then used else list_concat(used, keys) end, not list_has_any(used, keys) from g join k on k.n = g.n + 1)
    select doc_id, row_number() over (order by n) as ref from g where kept""")
def identity_dedup_greedy(spark, sf_dir):
    """Keeps a document unless a kept earlier one has its opening or its length and source."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.concat(F.lit("t:"), title_signature(F.substring("text", 1, 80))), F.concat_ws(":", F.lit("n"), "n_chars", "source")).alias("keys"))
    return identity.dedup_records(d, "doc_id", "keys").select("doc_id", "ref")


@query("receipt_dedup_greedy", r"""with recursive d as (select doc_id as ord, case when doc_id % 3 = 0 then '10.1/' || n_chars end as doi, n_chars, left(regexp_replace(trim(lower(text)), '\s+', ' ', 'g'), 200) as thesis, nullif(regexp_replace(lower(left(text, 60)), '[^a-z0-9]+', '', 'g'), '') as title from documents),
    k as (select *, row_number() over (order by doi is null, n_chars desc, ord) as n from d),
    g as (select cast(0 as bigint) as n, cast(0 as bigint) as ord, cast(null as varchar) as doi, cast(0 as bigint) as n_chars, cast([] as struct(thesis varchar, doi varchar, title varchar)[]) as used, false as kept
      union all select k.n, k.ord, k.doi, k.n_chars, case when c then used else list_append(used, {'thesis': k.thesis, 'doi': k.doi, 'title': k.title}) end, not c from (select g.n as m, used, k.*,
        len(list_filter(used, lambda u: u.thesis = k.thesis or coalesce(u.doi = k.doi, false) or (coalesce(u.title = k.title, false) and coalesce(u.doi = k.doi, true)))) > 0 as c from g join k on k.n = g.n + 1) k)
    select ord, doi, n_chars as n_claims from g where kept""")
def receipt_dedup_greedy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.lit(None).cast("string").alias("trial"), F.col("text").alias("thesis"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/"), F.col("n_chars").cast("string"))).alias("doi"),
        F.lit(None).cast("string").alias("pmid"), F.substring("text", 1, 60).alias("title"), F.lit(None).cast("int").alias("year"), F.col("n_chars").alias("n_claims"))
    return identity.dedup_receipts(d).select("ord", "doi", "n_claims")


@query("crosswalk_join", """with s as (select c_custkey as id, case when c_custkey % 5 = 0 then c_nationkey end as doi, c_mktsegment || cast(c_custkey % 40 as varchar) as title from customer),
    m as (select s_suppkey as meta_id, case when s_suppkey % 2 = 0 then s_nationkey end as doi, (['BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD', 'AUTOMOBILE'])[s_nationkey % 5 + 1] || cast(s_suppkey % 40 as varchar) as title from supplier),
    bd as (select doi, min(meta_id) as m from m where doi is not null group by doi), bt as (select title, min(meta_id) as m from m group by title having count(*) = 1)
    select id, coalesce(bd.m, bt.m) as meta_id, case when bd.m is not null then 'doi' when bt.m is not null then 'title' end as how from s left join bd using (doi) left join bt using (title)""")
def crosswalk_join(spark, sf_dir):
    names = F.array(*map(F.lit, ("BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE")))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey")).alias("doi"), F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("title"))
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("meta_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("doi"), F.concat(F.get(names, F.col("s_nationkey") % 5), (F.col("s_suppkey") % 40).cast("string")).alias("title"))
    return identity.crosswalk(s, m)


@query("citation_duplicate_keys", "select left(lower(text), 80) as key, count(distinct doc_id) as n from documents group by 1 having count(distinct doc_id) > 1")
def citation_duplicate_keys(spark, sf_dir):
    return identity.alias_issues(table(spark, sf_dir, "documents").select(F.substring(F.lower("text"), 1, 80).alias("key"), "doc_id"), "key", "doc_id").withColumnRenamed("identities", "n")


@query("best_run_per_topic", "select o_custkey, arg_max(o_orderkey, (case o_orderstatus when 'F' then 2 when 'O' then 1 else 0 end, o_totalprice, o_orderkey)) as best, count(*) as runs from orders group by o_custkey")
def best_run_per_topic(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return identity.best_run(o, "o_custkey", "o_orderkey", [rank, F.col("o_totalprice"), F.col("o_orderkey")])


@query("citation_labels", """with r as (select c_custkey, c_mktsegment as author, 1990 + c_custkey % 30 as year, c_nationkey % 7 as source from customer),
    s as (select author, year, source, min(c_custkey) as f from r group by all), k as (select *, count(*) over (partition by author, year) as n, row_number() over (partition by author, year order by f, source) - 1 as k from s)
    select c_custkey, author || ' ' || year || case when n > 1 then chr(cast(97 + k as int)) else '' end as label from r join k using (author, year, source)""")
def citation_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("author"), (1990 + F.col("c_custkey") % 30).alias("year"), (F.col("c_nationkey") % 7).alias("source"))
    return identity.citation_labels(c, "author", "year", "source", "c_custkey").select("c_custkey", "label")


@query("reconcile_markers", """with l as (select event_id as id, case when event_id % 3 = 0 then 'S' || event_id end as sub_id, case when event_id % 5 = 0 then md5(cast(event_id as varchar)) end as sha, event_type || user_id as title from events),
    r as (select doc_id as rid, 'S' || doc_id * 2 as sub_id, md5(cast(doc_id * 5 as varchar)) as sha, (['view', 'click', 'purchase'])[doc_id % 3 + 1] || doc_id as title from documents),
    t as (select title from l group by title having count(*) = 1 intersect select title from r group by title having count(*) = 1),
    f as (select id, rid, 0 as rank from l join r using (sub_id) union all select id, rid, 1 from l join r using (sha) union all select l.id, r.rid, 2 from l join r using (title) where title in (from t)),
    b as (select id, min((rank, rid)) as m, arg_min(rid, (rank, rid)) as rid, min(rank) as rank from f group by id)
    select l.id, b.rid, (['submission', 'hash', 'title'])[b.rank + 1] as marker from l left join b using (id)""")
def reconcile_markers(spark, sf_dir):
    e, d = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    text = lambda c: F.col(c).cast("string")
    local = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("S"), text("event_id"))).alias("sub_id"), F.when(F.col("event_id") % 5 == 0, F.md5(text("event_id"))).alias("sha"), F.concat("event_type", text("user_id")).alias("title"))
    names = F.array(*map(F.lit, ("view", "click", "purchase")))
    remote = d.select(F.col("doc_id").alias("rid"), F.concat(F.lit("S"), (F.col("doc_id") * 2).cast("string")).alias("sub_id"), F.md5((F.col("doc_id") * 5).cast("string")).alias("sha"), F.concat(F.get(names, (F.col("doc_id") % 3).cast("int")), text("doc_id")).alias("title"))
    return identity.reconcile(local, remote)


@query("clean_text", r"""select page_id, trim(left(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)</?(b|i|em|strong|sub|sup|u|span)(\s[^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f\x0b]+', ' ', 'g')), 1600)) as body from pages""")
def clean_text_(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean_text(F.col("html")).alias("body"))


@query("normalize_doi", r"""with r as (select p_partkey, (['https://doi.org/10.', 'doi: 10.', 'http://dx.doi.org/10.', '10.', 'see '])[p_partkey % 5 + 1] || (1000 + p_size) || '/' || p_brand as raw from part),
    x as (select p_partkey, regexp_replace(lower(trim(raw)), '^(https?://)?(dx\.)?doi\.org/|^doi:\s*', '') as d from r) select p_partkey, case when regexp_matches(d, '^10\.[0-9]{4,9}/[^ ]+$') then d end as doi from x""")
def normalize_doi_(spark, sf_dir):
    heads = F.array(*map(F.lit, ("https://doi.org/10.", "doi: 10.", "http://dx.doi.org/10.", "10.", "see ")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.get(heads, (F.col("p_partkey") % 5).cast("int")), (1000 + F.col("p_size")).cast("string"), F.lit("/"), "p_brand").alias("raw"))
    return p.select("p_partkey", normalize_doi(F.col("raw")).alias("doi"))


_SIGN = "case when l_tax > 0.05 then 1 when l_tax < 0.03 then -1 else 0 end"


@query("effect_direction_by_group", """with r as (select user_id, case event_type when 'purchase' then 1 when 'click' then -1 else 0 end as sign, value / 1000 < 0.05 as sig from events),
    a as (select user_id, bool_or(sig and sign > 0) as up, bool_or(sig and sign < 0) as down, bool_or(sig is not null) as tested from r group by user_id)
    select user_id, case when up and down then 'mixed' when up then 'positive' when down then 'negative' when tested then 'null' else 'unclear' end as direction from a""")
def effect_direction_by_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", -1).otherwise(0).alias("sign"), aggregates.significant(F.lit("="), F.col("value") / 1000).alias("sig"))
    return aggregates.effect_direction(e, ["user_id"])


@query("receipt_aggregate_mode", """with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by all) select user_id, arg_max(event_type, (n, -f)) as event_type, max(n) as n from c group by user_id""")
def receipt_aggregate_mode(spark, sf_dir):
    return aggregates.mode(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("outcome_direction_profile", """with c as (select user_id, event_type, count(*) as c from events group by all), t as (select user_id, sum(c) as n, max(c) as best from c group by all)
    select user_id, cast(n as bigint) as n, case when count(*) > 1 then 'mixed' else min(event_type) end as dominant from c join t using (user_id) where c = best group by user_id, n""")
def outcome_direction_profile(spark, sf_dir):
    return aggregates.direction_profile(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("histograms", """select 'o_orderstatus' as field, coalesce(nullif(o_orderstatus, ''), 'unknown') as value, count(*) as n from orders group by 2 union all
    select 'o_orderpriority', coalesce(nullif(o_orderpriority, ''), 'unknown'), count(*) from orders group by 2""")
def histograms(spark, sf_dir):
    return aggregates.histogram(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


_TIER = "(['A1', 'A2', 'B1', 'B', 'B2', 'C1', 'D1', 'X'])[o_orderkey % 8 + 1]"
_WEIGHT = f"(case {_TIER} when 'A1' then 1.0 when 'A2' then 0.7 when 'B1' then 0.6 when 'B' then 0.5 when 'B2' then 0.4 when 'C1' then 0.3 when 'D1' then 0.1 else 0.2 end)::double"


def tier_of(key):
    return F.get(F.array(*map(F.lit, ("A1", "A2", "B1", "B", "B2", "C1", "D1", "X"))), (F.col(key) % 8).cast("int"))


@query("tier_weighted_profile", f"""select o_orderpriority, round(sum({_WEIGHT}), 4) as total, round(sum(case when o_orderstatus = 'F' then {_WEIGHT} else 0 end), 4) as clinical,
    round(sum(case when o_orderstatus = 'F' then 0 else {_WEIGHT} end), 4) as mechanistic, count(*) as n from orders group by all""")
def tier_weighted_profile(spark, sf_dir):
    from weft.operators.classify import DEFAULT_WEIGHT, TIER_WEIGHT, lookup

    o = table(spark, sf_dir, "orders").withColumn("tier", tier_of("o_orderkey"))
    return aggregates.weighted_profile(o, ["o_orderpriority"], lookup(TIER_WEIGHT, F.col("tier"), DEFAULT_WEIGHT), F.col("o_orderstatus") == "F")


@query("admission_funnel", """with r as (select doc_id, case when quality is null then 'unlabelled' when quality = 0 then 'low_quality' when n_chars < 500 then 'short' else 'included' end as reason from documents left join labels using (doc_id))
    select reason, count(*) as n, array_to_string((list(doc_id order by doc_id))[1:8], ',') as examples from r group by reason""")
def admission_funnel(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 0, "low_quality").when(F.col("n_chars") < 500, "short").otherwise("included")
    return aggregates.admission_funnel(d.withColumnRenamed("doc_id", "id"), reason).select("reason", "n", F.array_join("examples", ",").alias("examples"))


@query("unique_trials", r"""select source, count(distinct case when doc_id % 4 = 0 then 'NCT' || n_chars else 'untrialed:' || left(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 120) end) as trials from documents group by source""")
def unique_trials(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("nct"), F.col("n_chars").cast("string"))).alias("trial"), F.col("text").alias("thesis"))
    return aggregates.unique_trials(d, ["source"])


@query("hedge_threshold", """with c as (select l_suppkey, l_tax > 0.04 as unclean from lineitem where l_discount > 0.05), p as (select l_suppkey, avg(unclean::int) as r from c group by all), s as (select count(*) as papers, round(coalesce(avg((r > 0.5)::int), 0), 6) as unclean_share from p)
    select *, case when unclean_share > 0.5 then 6 else 4 end as threshold from s""")
def hedge_threshold(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("paper"), F.when(F.col("l_discount") > 0.05, "high").otherwise("partial").alias("confidence"), (F.col("l_tax") > 0.04).alias("unclean"))
    return aggregates.hedge_threshold(c)


@query("cross_topic_contradictions", f"""with r as (select s_nationkey as topic, l_partkey % 50 as outcome, {_SIGN} as sign from lineitem join supplier on l_suppkey = s_suppkey),
    n as (select topic, outcome, count(*) filter (where sign > 0) as p, count(*) filter (where sign < 0) as m from r group by all),
    g as (select outcome, list_sort(list(topic) filter (where p > m)) as a, list_sort(list(topic) filter (where m > p)) as b from n group by outcome)
    select outcome, array_to_string(a, ',') as positive_topics, array_to_string(b, ',') as negative_topics from g where len(a) > 0 and len(b) > 0""")
def cross_topic_contradictions(spark, sf_dir):
    sign = F.when(F.col("l_tax") > 0.05, 1).when(F.col("l_tax") < 0.03, -1).otherwise(0)
    s = table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == s.s_suppkey).select(F.col("s_nationkey").alias("topic"), (F.col("l_partkey") % 50).alias("outcome"), sign.alias("sign"))
    return aggregates.contradictions(rows).select("outcome", F.array_join("positive_topics", ",").alias("positive_topics"), F.array_join("negative_topics", ",").alias("negative_topics"))


@query("mechanism_convergences", """select p_brand as mechanism, array_to_string(list_sort(list(distinct s_nationkey)), ',') as topics from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey where l_returnflag = 'R' and p_size > 40 group by 1 having count(distinct s_nationkey) >= 2""")
def mechanism_convergences(spark, sf_dir):
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part").where("p_size > 40")
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(s, F.col("l_suppkey") == s.s_suppkey).join(p, F.col("l_partkey") == p.p_partkey)
    return aggregates.convergences(rows.select(F.col("s_nationkey").alias("topic"), F.col("p_brand").alias("mechanism"))).select("mechanism", F.array_join("topics", ",").alias("topics"))
