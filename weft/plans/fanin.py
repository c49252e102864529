"""Queries of source quotas, widened searches and submission markers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators import fanin, submissions
from weft.plans.outcomes import _values
from weft.plans.streams import events, folder
from weft.plans.tables import registrar, table
from weft.streaming import ledger, markers

QUERIES, SQL, query = registrar()

CAP, PER_SOURCE = 40, 30


def hits(spark, sf_dir):
    """Line items as hits: an order's key gives the topic, the supplier the source, and the ranks are those of the parts."""
    line = table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_suppkey") % 7 < 4, 0).otherwise(F.col("l_suppkey") % 7)
    keyed = line.groupBy((F.col("l_orderkey") % 500).alias("topic"), source.alias("source"), "l_partkey").agg(F.min("l_orderkey").alias("hit"))
    return keyed.withColumn("rank", F.row_number().over(W.partitionBy("topic", "source").orderBy("l_partkey")))


_HITS = """h as (select *, row_number() over (partition by topic, source order by l_partkey) as rank from (
    select l_orderkey % 500 as topic, case when l_suppkey % 7 < 4 then 0 else l_suppkey % 7 end as source, l_partkey, min(l_orderkey) as hit from lineitem group by all)),
    n as (select topic, source, count(*) as n from h where rank <= {most} group by topic, source),
    levels as (select topic, max(l) as l from (select topic, l, sum(least(n, l)) as used from n, range(0, {top}) as r(l) group by topic, l) where used <= {cap} group by topic),
    used as (select n.topic, l, {cap} - sum(least(n, l)) as odd from n join levels using (topic) group by n.topic, l),
    q as (select topic, source, n, least(n, l) + case when n > l and row_number() over (partition by topic, n > l order by source) <= odd then 1 else 0 end as quota from n join used using (topic))"""


@query("source_quotas", f"with {_HITS.format(most=PER_SOURCE, top=PER_SOURCE + 1, cap=CAP)} select topic, source, n, cast(quota as bigint) as quota from q")
def source_quotas(spark, sf_dir):
    found = hits(spark, sf_dir).where(F.col("rank") <= PER_SOURCE).groupBy("topic", "source").agg(F.count("*").alias("n"))
    return fanin.quotas(found, CAP)


@query("fan_in", f"with {_HITS.format(most=PER_SOURCE, top=PER_SOURCE + 1, cap=CAP)} select topic, source, l_partkey, hit, rank from h join q using (topic, source) where rank <= quota")
def fan_in(spark, sf_dir):
    return fanin.fan_in(hits(spark, sf_dir), PER_SOURCE, CAP).select("topic", "source", "l_partkey", "hit", "rank")


@query("fan_in_stats", f"""
    with {_HITS.format(most=PER_SOURCE, top=PER_SOURCE + 1, cap=CAP)}, asked as (select distinct topic, unnest([0, 4, 5, 6, 9]) as source from h), raw as (select topic, source, count(*) as raw from h group by all), every as (
    select topic, asked.source, case when asked.source = 9 then 'timeout' else 'ok' end as status, coalesce(raw, 0) as raw, coalesce(quota, 0) as taken from asked left join raw using (topic, source) left join q using (topic, source))
    select topic, source, raw, cast(taken as bigint) as taken, status, sum(raw) over (partition by topic) > {CAP} as capped from every""")
def fan_in_stats(spark, sf_dir):
    h = hits(spark, sf_dir)
    asked = h.select("topic").distinct().select("topic", F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 4, 5, 6, 9)])).alias("source")).withColumn("status", F.when(F.col("source") == 9, "timeout").otherwise("ok"))
    return fanin.fan_in_stats(h, fanin.fan_in(h, PER_SOURCE, CAP), asked, CAP)


PRECURSORS, GENERAL = {"nad": ["niacin", "NMN"], "diet": ["fasting"]}, ["biomarker", "human trial"]
#: (name, terms, status, cap, counts) and (terms, rounds, status, reason) that they come to.
PACKS = [
    ("NAD boosters", ["nmn"], "open", 900, [5, 80], ["nmn", "niacin", "biomarker", "human trial"], 1, "enough", "candidate floor met"), ("Sleep", ["sleep"], "open", 900, [70], ["sleep"], 0, "enough", "candidate floor met"),
    ("Sleep", ["sleep"], "open", 50, [10, 55], ["sleep", "biomarker", "human trial"], 1, "stop", "candidate cap reached"), ("Diet", ["diet"], "stop", 900, [1], ["diet"], 0, "stop", "pack is stopped"),
    ("Diet", ["diet"], "open", 900, [1, 2, 3, 100], ["diet", "fasting", "biomarker", "human trial"], 1, "stop", "no new expansion terms"), ("Diet", ["diet"], "open", 900, [], ["diet"], 0, "stop", "no retrieval counts supplied"),
    ("Walks", ["walk"], "open", 900, [3], ["walk", "biomarker", "human trial"], 1, "expand", "candidate floor not met"),
]


@query("widened_searches", f"""with t(k, terms, rounds, status, reason) as (values {_values([(i, "|".join(p[5]), *p[6:]) for i, p in enumerate(PACKS)])}) select o_orderkey as topic, terms, rounds, status, reason from orders join t on k = o_orderkey % {len(PACKS)}""")
def widened_searches(spark, sf_dir):
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    packs = [F.struct(F.lit(n).alias("name"), strings(t).alias("terms"), F.lit(s).alias("status"), F.lit(c).alias("candidate_cap"), F.array(*map(F.lit, k)).cast("array<int>").alias("counts")) for n, t, s, c, k, *_ in PACKS]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("topic"), F.get(F.array(*packs), (F.col("o_orderkey") % len(PACKS)).cast("int")).alias("p")).select("topic", "p.*")
    return fanin.widened(rows, PRECURSORS, GENERAL).select("topic", F.array_join("terms", "|").alias("terms"), "rounds", "status", "reason")


@query("stopped_widening", "select o_orderkey as topic, 'walk|b1|b2' as terms, 2 as rounds, 'stop' as status, 'max rounds reached' as reason from orders")
def stopped_widening(spark, sf_dir):
    """Two rounds that each find a new term, and no more rounds."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("topic"), F.lit("Walks").alias("name"), F.array(F.lit("walk")).alias("terms"), F.lit("open").alias("status"), F.lit(900).alias("candidate_cap"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("counts"))
    out = fanin.widened(rows, {"walk": ["b1"], "b1": ["b2"]}, [], max_rounds=2)
    return out.select("topic", F.array_join("terms", "|").alias("terms"), "rounds", "status", "reason")


def children(spark, sf_dir):
    """Line items as children of their orders' ledgers; two of three have a marker, one in five no run."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    marks = F.when(k % 3 > 0, F.array(F.concat(F.lit("submission:"), F.col("l_partkey")), F.concat(F.lit("title:"), F.col("l_partkey")), F.concat(F.lit("submission:"), F.col("l_partkey"))))
    run = F.when(k % 5 > 0, F.concat(F.lit("run"), F.col("l_suppkey")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row"), F.col("l_orderkey").alias("ledger"), F.when(k % 2 == 0, "attempts").otherwise("submissions").alias("kind"), run.alias("run"), marks.alias("markers"),
        (k % 4 > 0).cast("int").alias("submitted"), (k % 4 == 1).cast("int").alias("published"),
    )


_KIDS = """c as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row, l_orderkey as ledger, case when k % 2 = 0 then 'attempts' else 'submissions' end as kind, case when k % 5 > 0 then 'run' || l_suppkey end as run,
        case when k % 3 > 0 then l_partkey end as part, case when k % 4 > 0 then 1 else 0 end as submitted, case when k % 4 = 1 then 1 else 0 end as published, l_suppkey
    from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber as k from lineitem))"""


@query("ledger_markers", f"with {_KIDS} select distinct ledger, 'submission:' || part as marker from c where part is not null union select o_orderkey, 'submission:' || o_custkey from orders where o_orderkey % 3 = 0")
def ledger_markers(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ledger"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.concat(F.lit(" "), F.col("o_custkey")), F.lit(" "))).alias("submission_ids"))
    return submissions.ledger_markers(own, children(spark, sf_dir))


def _matched(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    runs = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("ledger"), F.concat(F.lit("run"), F.col("o_custkey") % 100 + 1).alias("run"))
    marks = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.concat(F.lit("submission:"), F.col("p_partkey")).alias("marker"))
    return runs, marks


_MATCH = f"""{_KIDS}, runs as (select o_orderkey as ledger, 'run' || (o_custkey % 100 + 1) as run from orders where o_orderkey % 2 = 0),
    m as (select c.*, exists (select 1 from runs r where r.ledger = c.ledger and r.run = c.run) as by_run, coalesce(part % 10 = 0 and part in (select p_partkey from part), false) as by_mark, c.ledger in (select ledger from runs) as known from c)"""


@query("children_synced", f"""with {_MATCH}, n as (select *, case when by_run or by_mark then 1 else submitted end as s, case when by_run or by_mark then 1 else 0 end as p from m)
    select row, ledger, kind, run, s as submitted, p as published, s <> submitted or p <> published as changed from n""")
def children_synced(spark, sf_dir):
    return submissions.synced_children(children(spark, sf_dir), *_matched(spark, sf_dir))


_FIRST = "(run is null or by_run or (not known and run in (select 'run' || s_suppkey from supplier where s_suppkey % 2 = 0)))"


@query("children_first_synced", f"""with {_MATCH}, f as (select *, case when kind = 'attempts' then {_FIRST} else by_run or by_mark end as hit from m)
    select row, ledger, kind, run, case when hit then 1 else submitted end as submitted, case when hit then 1 else published end as published, hit and (submitted = 0 or published = 0) as changed from f""")
def children_first_synced(spark, sf_dir):
    sent = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("run"), F.col("s_suppkey")).alias("run"))
    return submissions.synced_children(children(spark, sf_dir), *_matched(spark, sf_dir), sent)


@query("child_counts", f"with {_KIDS} select ledger, sum(submitted) as submitted, sum(published) as published from c where kind = 'submissions' group by ledger")
def child_counts(spark, sf_dir):
    return submissions.child_counts(children(spark, sf_dir))


def ledger_events(rows):
    """Events as submissions and publications of a user's marker; other kinds stand for nothing."""
    kind = F.when(F.col("event_type") == "purchase", "publication").when(F.col("event_type") == "view", "submission")
    return rows.select(F.concat(F.lit("submission:"), F.col("user_id")).alias("marker"), kind.alias("kind"), F.col("event_id").cast("string").alias("run"), F.col("ts").cast("timestamp").alias("ts")).where("kind is not null")


TTL_HOURS = 6
_SETTLED = f"""
    with e as (select 'submission:' || user_id as marker, event_type, cast(event_id as varchar) as run, cast(ts as timestamp) as ts from events where event_type in ('purchase', 'view')), w as (select max(ts) - interval 1 day as at from e),
    s as (select marker, run, ts as submitted_at, (select min(p.ts) from e p where p.marker = e.marker and p.event_type = 'purchase' and p.ts between e.ts - interval {TTL_HOURS} hour and e.ts + interval {TTL_HOURS} hour) as published_at from e where event_type = 'view')
    select marker, run, cast(submitted_at as varchar) as submitted_at, cast(published_at as varchar) as published_at, case when published_at is not null then 'published' else 'expired' end as status
    from s, w where published_at is not null or submitted_at + interval {TTL_HOURS} hour <= w.at"""


def _shown(rows):
    """Times as DuckDB prints them: a fraction only where there is one."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return rows.select("marker", "run", plain(F.col("submitted_at")).alias("submitted_at"), plain(F.col("published_at")).alias("published_at"), "status")


@query("settled_submissions", _SETTLED)
def settled_submissions(spark, sf_dir):
    rows = ledger_events(table(spark, sf_dir, "events"))
    until = rows.agg(F.max("ts") - F.expr("interval 1 day")).first()[0]
    return _shown(submissions.settled(rows, f"{TTL_HOURS} hours", F.lit(until)))


@query("stream_settled", _SETTLED)
def stream_settled(spark, sf_dir):
    """The same by keyed state with timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, markers.STATE_STORE)
    try:
        out = ledger.run_once(markers.settled(ledger_events(events(spark, sf_dir)), TTL_HOURS * 3_600_000), folder(spark))
    finally:
        spark.conf.set(name, before)
    return _shown(out)
