"""Queries of gates, appraisals, ledgers and fact groups on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import gates, ledger
from weft.operators.select import cut
from weft.plans.evidence import _TIER, tier_of
from weft.plans.tables import registrar, table

QUERIES, SQL, query = registrar()
#: The day after the last event.
NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("regression_compare", """with s as (select c_nationkey as k, o_orderdate < timestamp '1995-01-01' as old, o_totalprice, o_orderstatus from orders join customer on o_custkey = c_custkey),
    g as (select k, old, count(*)::double as receipts, avg(o_totalprice) as price, count(*) filter (where o_orderstatus = 'F')::double as done from s group by all),
    j as (select k, a.receipts as r0, b.receipts as r1, a.price as p0, b.price as p1, a.done as d0, b.done as d1 from (select * from g where old) a full join (select * from g where not old) b using (k))
    select k, 'receipts' as dimension, r0 as old, r1 as new, coalesce(r1 >= r0 - 5, false) as passed from j union all select k, 'price', round(p0, 4), round(p1, 4), coalesce(p1 <= p0 + 100, false) from j union all select k, 'done', d0, d1, coalesce(d1 >= 10, false) from j""")
def regression_compare(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("k"), (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")).alias("old")).agg(F.count("*").alias("receipts"), F.avg("o_totalprice").alias("price"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    out = gates.compare_runs(g.where("old").drop("old"), g.where("not old").drop("old"), "k", {"receipts": ("higher", 5.0), "price": ("lower", 100.0), "done": ("floor", 10.0)})
    return out.select("k", "dimension", F.round("old", 4).alias("old"), F.round("new", 4).alias("new"), "passed")


_SCALE = "['low', 'some concerns', 'high']"


@query("rob_worst_domain", f"""select l_suppkey, ({_SCALE})[max(case when l_discount > 0.09 and l_tax > 0.07 and l_quantity > 48 then 3 when l_discount > 0.05 then 2 else 1 end)] as overall from lineitem group by all""")
def rob_worst_domain(spark, sf_dir):
    r = F.when((F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07) & (F.col("l_quantity") > 48), "high").when(F.col("l_discount") > 0.05, "some concerns").otherwise("low")
    return gates.worst_domain(table(spark, sf_dir, "lineitem").withColumn("r", r), "l_suppkey", "r", ["low", "some concerns", "high"])


@query("grade_final", "select p_partkey, (['very low', 'low', 'moderate', 'high'])[greatest(1, least(4, case when p_size % 2 = 0 then 4 else 2 end - p_size % 5 + p_size % 3))] as certainty from part")
def grade_final(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", gates.grade_certainty(F.when(F.col("p_size") % 2 == 0, 4).otherwise(2), F.col("p_size") % 5, F.col("p_size") % 3).alias("certainty"))


@query("rubric_rollup", """with l as (select s_suppkey as id, s_nationkey, case when s_acctbal > 5000 then 1.0 when s_acctbal > 0 then 0.5 when s_acctbal > -500 then 0.0 end as score from supplier),
    n as (select s_nationkey as k, round(case when bool_or(id % 7 = 0 and score <= 0) then 0 when s_nationkey % 3 = 0 then min(score) else avg(score) end, 6) as score from l where score is not null group by s_nationkey),
    g as (select n_regionkey as k, round(case when bool_or(n_nationkey % 5 = 0 and score <= 0) then 0 else avg(score) end, 6) as score from n join nation on n_nationkey = k group by n_regionkey),
    r as (select round(min(score), 6) as score from g),
    a as (select 's' || id as id, score from l union all select 'n' || k, score from n union all select 'r' || k, score from g union all select 'root', score from r where score is not null)
    select id, score, case when score >= 0.8 then 'passed' when score <= 0 then 'failed' else 'partial' end as status from a""")
def rubric_rollup(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = (
        s.select(key("s", "s_suppkey").alias("id"), key("n", "s_nationkey").alias("parent"), F.lit(3).alias("depth"), F.lit("mean").alias("strategy"), (F.col("s_suppkey") % 7 == 0).alias("critical"))
        .union(n.select(key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit(2), F.when(F.col("n_nationkey") % 3 == 0, "min").otherwise("mean"), F.col("n_nationkey") % 5 == 0))
        .union(r.select(key("r", "r_regionkey"), F.lit("root"), F.lit(1), F.lit("mean"), F.lit(False)))
        .union(r.limit(1).select(F.lit("root"), F.lit(None).cast("string"), F.lit(0), F.lit("min"), F.lit(False)))
    )
    leaves = s.select(key("s", "s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, 1.0).when(F.col("s_acctbal") > 0, 0.5).when(F.col("s_acctbal") > -500, 0.0).alias("score"))
    return gates.rollup(cut(tree), leaves, 3)


@query("first_assessment", "select l_suppkey, l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) = 1")
def first_assessment(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))
    return gates.first_assessment(rows, "l_suppkey", "o").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("invariant_violations", "select doc_id, 'no item' as problem from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'role mismatch' from documents join labels using (doc_id) where (lang = 'en' and quality <> 1) or (lang = 'fr' and quality <> 0)")
def invariant_violations(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").withColumn("role", F.col("quality").cast("string"))
    return gates.violations(d, i, "doc_id", "lang", "role", {"en": "1", "fr": "0"})


@query("admission_mismatch", """with a as (select doc_id from documents where n_chars > 500), b as (select doc_id from labels), c as (select doc_id from labels where toxic = 1)
    select doc_id, 'no receipt' as problem from (select doc_id from a except select doc_id from b) union all select doc_id, 'not admitted' from (select doc_id from b except select doc_id from a) union all select doc_id, 'both' from (select doc_id from a intersect select doc_id from c)""")
def admission_mismatch(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return gates.admission_mismatch(d.where("n_chars > 500"), i, i.where("toxic = 1"), "doc_id")


@query("ledger_conversion_funnel", """with f as (select user_id, bool_or(event_type = 'view') as seen, bool_or(event_type = 'click') as ready, bool_or(event_type = 'purchase') as submitted, bool_or(event_type = 'purchase' and value > 50) as published from events group by user_id)
    select unnest(['seen', 'ready', 'submitted', 'published']) as stage, unnest([count(*) filter (where seen), count(*) filter (where ready), count(*) filter (where submitted), count(*) filter (where published)]) as candidates from f""")
def ledger_conversion_funnel(spark, sf_dir):
    t = F.col("event_type")
    return ledger.conversion_funnel(table(spark, sf_dir, "events"), "user_id", {"seen": t == "view", "ready": t == "click", "submitted": t == "purchase", "published": (t == "purchase") & (F.col("value") > 50)})


@query("top_blockers", "select k as code, count(distinct user_id) as candidates from (select user_id, json_extract_string(props, '$.k') as k from events) group by 1 order by candidates desc, code limit 8")
def top_blockers(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("code", F.get_json_object("props", "$.k"))
    return ledger.top_blockers(e, "user_id", "code")


@query("daily_throughput", "with l as (select cast(ts as date) as day, user_id, arg_max(event_type, (ts, event_id)) as s from events group by all) select cast(day as varchar) as day, count(*) as runs, count(*) filter (where s = 'purchase') as done from l group by l.day")
def daily_throughput(spark, sf_dir):
    return ledger.daily_throughput(table(spark, sf_dir, "events"), "ts", "event_type", "user_id").withColumn("day", F.col("day").cast("string"))


@query("ttl_prepared_candidates", f"with r as (select * from events where ts >= timestamp '{NOW}' - interval 7 day and event_type <> 'error') select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from r group by user_id")
def ttl_prepared_candidates(spark, sf_dir):
    e = ledger.recent(table(spark, sf_dir, "events"), "ts", "ts", now(), 7).where("event_type <> 'error'").select("user_id", "event_id", "event_type", "ts")
    return ledger.last_wins(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("trailing_topk", f"select user_id, count(*) as n from events where ts >= timestamp '{NOW}' - interval 14 day and ts <= timestamp '{NOW}' group by user_id order by n desc, user_id limit 8")
def trailing_topk(spark, sf_dir):
    return ledger.trailing_top(table(spark, sf_dir, "events"), "ts", "user_id", now(), 14)


@query("yield_stop_window", """with p as (select user_id as lane, cast(ts as date) as page, count(*) as hits, count(*) filter (where event_type = 'purchase') as new, count(*) filter (where value > 100) as core, count(*) filter (where event_type = 'view') as noise from events group by all),
    s as (select lane, page, count(*) over w = 5 as f, sum(new) over w / greatest(sum(hits) over w, 1) as n, sum(core) over w / greatest(sum(hits) over w, 1) as c, sum(noise) over w / greatest(sum(hits) over w, 1) as z from p window w as (partition by lane order by page rows between 4 preceding and current row))
    select lane, cast(page as varchar) as page, f and (n < 0.02 or c < 0.01 or z > 0.95) as stop from s""")
def yield_stop_window(spark, sf_dir):
    t = F.col("event_type")
    p = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("lane"), F.to_date("ts").alias("page")).agg(F.count("*").alias("hits"), F.count_if(t == "purchase").alias("new"), F.count_if(F.col("value") > 100).alias("core"), F.count_if(t == "view").alias("noise"))
    return ledger.yield_stop(p, "lane", "page").withColumn("page", F.col("page").cast("string"))


@query("history_compaction", """select event_id, user_id, event_type from events where event_type in ('purchase', 'error') qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1
    union all select event_id, user_id, event_type from events where event_type not in ('purchase', 'error') qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3""")
def history_compaction(spark, sf_dir):
    return ledger.compact_history(table(spark, sf_dir, "events"), "user_id", "event_type", ["purchase", "error"], ["ts", "event_id"], 3).select("event_id", "user_id", "event_type")


@query("drought_status", f"with d as (select event_type, (epoch(timestamp '{NOW}') - floor(epoch(max(ts)))) / 3600 as h from events group by all) select event_type, round(h, 4) as hours, case when h > 3 then 'fail' when h > 1 then 'degraded' else 'pass' end as status from d")
def drought_status(spark, sf_dir):
    return ledger.drought(table(spark, sf_dir, "events"), "event_type", "ts", now(), 1, 3)


@query("blocker_histogram", "with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) select user_id, event_type, count(*) as n, max(ts) as last_seen, string_agg(event_id, ',' order by event_id) filter (where k <= 3) as samples from r group by all")
def blocker_histogram(spark, sf_dir):
    return ledger.blocker_histogram(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").withColumn("samples", F.array_join("samples", ","))


@query("attempt_cooldown", f"select user_id, max(ts) as last_attempt, count(*) filter (where ts >= timestamp '{NOW}' - interval 7 day and event_type <> 'purchase') as blocked from events group by user_id")
def attempt_cooldown(spark, sf_dir):
    return ledger.cooldown(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "purchase", now(), 7)


@query("ledger_upsert", """with s as (select user_id, max(event_id) as event_id from events where event_type in ('view', 'click') group by all), n as (select user_id, arg_max(event_id, (ts, event_id)) as event_id from events where event_type not in ('view', 'click') group by all)
    select user_id, event_id from s where user_id not in (select user_id from n) union all select * from n""")
def ledger_upsert(spark, sf_dir):
    """Views and clicks are the state, all other events the news."""
    e = table(spark, sf_dir, "events")
    seen = F.col("event_type").isin("view", "click")
    state = e.where(seen).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    news = e.where(~seen).select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return ledger.upsert(state, news, ["user_id"], "at")


@query("reviews_by_day", "with l as (select cast(ts as date) as day, user_id, arg_max(event_type, event_id) as event_type from events group by all) select cast(day as varchar) as day, event_type, count(*) as n from l group by l.day, event_type")
def reviews_by_day(spark, sf_dir):
    return ledger.reviews_by_day(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day", "user_id", "event_type", "event_id").withColumn("day", F.col("day").cast("string"))


@query("revision_cap", "select user_id, count(*) filter (where event_type = 'click') as rounds, count(*) filter (where event_type = 'click') >= 15 as capped from events group by user_id")
def revision_cap(spark, sf_dir):
    return ledger.capped(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "click", 15)


@query("repeated_gate", "with o as (select *, 'C_' || event_type as code from events where event_type in ('view', 'click')), l as (select user_id, arg_max(code, (ts, event_id)) as code from o group by all) select user_id, code, count(*) as n from o join l using (user_id, code) group by all having count(*) >= 20")
def repeated_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("code", F.concat(F.when(F.col("event_type").isin("view", "click"), "C_").otherwise("B_"), "event_type"))
    return ledger.repeated_gate(e, "user_id", "code", ["ts", "event_id"], "C_", 20)


@query("attempt_gate_counts", "select split_part(event_type || ':' || user_id, ':', 1) as gate, count(*) as n from events group by 1")
def attempt_gate_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("status", F.concat_ws(":", "event_type", "user_id"))
    return e.groupBy(F.split_part("status", F.lit(":"), F.lit(1)).alias("gate")).agg(F.count("*").alias("n"))


def facts(spark, sf_dir):
    """Line items as facts with a JSON body; returned ones are rejected by validation."""
    k, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = k.join(p, k.l_partkey == p.p_partkey)
    body = F.to_json(F.struct(F.col("p_brand").alias("intervention"), F.col("p_type").alias("population"), F.col("l_quantity").cast("int").cast("string").alias("outcome")))
    return rows.select(F.col("l_suppkey").alias("paper_id"), F.col("l_quantity").alias("numeric_value"), body.alias("fact_json"), F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "exact").alias("status"))


_FACTS = "f as (select l_suppkey as paper_id, l_quantity as numeric_value, p_brand as intervention, p_type as population, cast(cast(floor(l_quantity) as int) as varchar) as outcome, case l_returnflag when 'R' then 'rejected' when 'A' then 'exact' end as status from lineitem join part on l_partkey = p_partkey)"


@query("fact_topics_grouped", f"with {_FACTS} select intervention, count(*) filter (where status = 'exact') as exact, count(distinct paper_id) as papers, count(*) as facts from f where status is null or status <> 'rejected' group by all having count(*) filter (where status = 'exact') >= 20 and count(distinct paper_id) >= 5 order by exact desc, intervention limit 50")
def fact_topics_grouped(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("intervention", F.get_json_object("fact_json", "$.intervention")).where("status is null or status <> 'rejected'")
    g = f.groupBy("intervention").agg(F.count_if(F.col("status") == "exact").alias("exact"), F.countDistinct("paper_id").alias("papers"), F.count("*").alias("facts"))
    return g.where("exact >= 20 and papers >= 5").orderBy(F.desc("exact"), "intervention").limit(50)


@query("fact_topics_unnested", f"""with {_FACTS}, u as (select paper_id, unnest(['intervention', 'population', 'outcome']) as key, unnest([intervention, population, outcome]) as value from f)
    select key, value, count(*) as facts, count(distinct paper_id) as papers from u where key in ('intervention', 'population') and length(value) between 3 and 40 group by all""")
def fact_topics_unnested(spark, sf_dir):
    u = facts(spark, sf_dir).select("paper_id", F.explode(F.from_json("fact_json", "map<string,string>")).alias("key", "value"))
    u = u.where(F.col("key").isin("intervention", "population") & F.length("value").between(3, 40))
    return u.groupBy("key", "value").agg(F.count("*").alias("facts"), F.countDistinct("paper_id").alias("papers"))


@query("fact_topics_pairs", f"with {_FACTS} select intervention || '::' || population as pair, count(*) as facts, round(avg(numeric_value), 6) as mean from f where split_part(intervention || '::' || population, '::', 2) like '%A%' group by all")
def fact_topics_pairs(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("pair", F.concat_ws("::", F.get_json_object("fact_json", "$.intervention"), F.get_json_object("fact_json", "$.population")))
    f = f.where(F.split_part("pair", F.lit("::"), F.lit(2)).contains("A"))
    return f.groupBy("pair").agg(F.count("*").alias("facts"), F.round(F.avg("numeric_value"), 6).alias("mean"))


@query("fact_topics_cross", f"with {_FACTS} select intervention, count(distinct population) as populations, count(*) as facts from f where intervention not like '%1' and intervention not in ('Brand#22') group by all having count(distinct population) >= 2")
def fact_topics_cross(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("intervention", F.get_json_object("fact_json", "$.intervention")).withColumn("population", F.get_json_object("fact_json", "$.population"))
    f = f.where(~F.col("intervention").like("%1") & ~F.col("intervention").isin("Brand#22"))
    return f.groupBy("intervention").agg(F.countDistinct("population").alias("populations"), F.count("*").alias("facts")).where("populations >= 2")
