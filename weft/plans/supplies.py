"""Queries of topic supply, rankings and provenance on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import ranking, records, supply
from weft.plans.operations import NOW, now
from weft.plans.studies import _cases
from weft.plans.tables import derived, derived_sql, registrar, table

QUERIES, SQL, query = registrar()

# Events are attempts: users are topics, and the kind of an event and its user give a status.
ATTEMPT = {
    "topic": "concat('t', cast(user_id as string))",
    "status": _cases("(event_id + user_id)", ["journal_surface_failed: x", "synthesis_timeout", "audit_not_all_green", "eligible", "retracted_source_cited", "preflight_thin_quant_corpus", "odd_gate", "needs_corpus_expansion", "journal_surface_failed"]),
    "submitted": "event_type = 'purchase'", "day": "ts",
}
_A = f"a as (select *, split_part(status, ':', 1) as code from {derived_sql('events', ATTEMPT, 'event_id', 'user_id', 'event_type', 'ts', 'value', 'props')})"


def _c(*names):
    return [F.col(n) for n in names]


def attempts(spark, sf_dir):
    a = derived(table(spark, sf_dir, "events"), ATTEMPT, "event_id", "user_id", "event_type", "ts", "value", "props")
    return a.withColumn("code", supply.code_of(F.col("status")))


_OVER = ", ".join(f"'{s}'" for s in (*supply.TERMINAL_REVISION, *supply.ACTIVE_TERMINAL_REVISION))
_CLASSES = f"case when code in ({_OVER}) then 'D_no_action' " + " ".join(f"when code = '{k}' then '{v}'" for k, v in supply.FAILURE_CLASS.items()) + " else 'unknown' end"
#: Every status of the table, one that is not in it, and one that a deployment adds.
ENDED = {"status": _cases("event_id", [*supply.FAILURE_CLASS, *supply.TERMINAL_REVISION, *supply.ACTIVE_TERMINAL_REVISION, "odd_gate: x", "", "own_service_rejected: twice"])}


@query("failure_classes", f"""
    with a as (select event_id, split_part(status, ':', 1) as code from {derived_sql('events', ENDED, 'event_id')})
    select event_id, case when code = 'own_service_rejected' then 'C_writer_fixable' else {_CLASSES} end as klass from a""")
def failure_classes(spark, sf_dir):
    rows = derived(table(spark, sf_dir, "events"), ENDED, "event_id")
    return rows.select("event_id", supply.failure_class(F.col("status"), {"own_service_rejected": "C_writer_fixable"}).alias("klass"))


RECEIPT = {"tier": _cases("l_partkey", ["A1", "a2", "B1", "B2", "C", ""]), "directness": "case when l_suppkey % 4 = 0 then null when l_linenumber % 3 = 0 then 'Direct' else 'indirect' end", "outcome": _cases("l_partkey", ["frailty", " ", "safety", "mortality", ""])}


@query("manifest_counts", f"with r as {derived_sql('lineitem', RECEIPT, 'l_suppkey')} select l_suppkey, count(*) as receipts, count(*) filter (where upper(tier) in ('A1', 'A2', 'B1')) as primary_tier, case when count(directness) > 0 then count(*) filter (where lower(directness) = 'direct') else count(*) filter (where upper(tier) in ('A1', 'A2', 'B1')) end as direct_receipts, count(distinct nullif(trim(outcome), '')) as outcome_classes from r group by l_suppkey")
def manifest_counts(spark, sf_dir):
    return supply.manifest_counts(derived(table(spark, sf_dir, "lineitem"), RECEIPT, "l_suppkey"), "l_suppkey")


@query("topic_run_stats", "select o_custkey, count(*) as runs, count(*) filter (where o_orderkey % 6 >= 4) as certified from orders group by o_custkey")
def topic_run_stats(spark, sf_dir):
    return supply.run_stats(table(spark, sf_dir, "orders").withColumn("level", F.col("o_orderkey") % 6), "o_custkey", "level")


_LATE = f"ts >= timestamp '{NOW}' - interval 240 hour"


@query("attempt_history", f"with {_A} select topic, max(ts) as last, count(*) filter (where {_LATE} and not submitted) as failures from a group by topic")
def attempt_history(spark, sf_dir):
    return supply.attempt_history(attempts(spark, sf_dir), "topic", "ts", F.col("submitted"), now(), 240)


_NEVER = ", ".join(f"'{x}'" for x in (*supply.NEVER_REPEATS, *supply.PREFLIGHT))


@query("surface_repeats", f"""with {_A}, f as (select topic, code, count(*) as n, max(ts) as last from a where code not in ({_NEVER}) and {_CLASSES.replace("'C_writer_fixable' end", "'' end")} not like 'C%' and {_LATE} group by all having count(*) >= 3),
    r as (select topic, max(ts) as ready from a where submitted group by topic) select distinct f.topic from f left join r using (topic) where ready is null or ready <= last""")
def surface_repeats(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return supply.repeated_surface(a.select("topic", "code", "ts"), a.where("submitted").select("topic", "ts"), now(), 240, 3)


@query("recent_blocked", f"with {_A} select topic, 'any' as how from (select distinct topic from a where {_LATE.replace('240', '2')} and code not in ({', '.join(repr(x) for x in supply.NEVER_REPEATS)})) union all select topic, 'preflight' from (select distinct topic from a where {_LATE.replace('240', '2')} and code = 'preflight_thin_quant_corpus')")
def recent_blocked(spark, sf_dir):
    s = attempts(spark, sf_dir).select("topic", "code", "ts")
    return supply.recent_blocked(s, now(), 2).withColumn("how", F.lit("any")).union(supply.recent_blocked(s, now(), 2, list(supply.PREFLIGHT)).withColumn("how", F.lit("preflight")))


REPAIR = """case event_id % 4 when 0 then '{"status": "source_precision_repair_incomplete", "n_quant_claims": 0}' when 1 then '{"status": "source_precision_repair_incomplete", "n_quant_claims": 4}' when 2 then '{"status": "source_precision_repaired"}' else null end"""


@query("unrepairable_topics", f"select distinct concat('t', user_id) as topic from events where event_id % 4 = 0 and ts >= timestamp '{NOW}' - interval 3 hour")
def unrepairable_topics(spark, sf_dir):
    return supply.unrepairable(attempts(spark, sf_dir).withColumn("repair", F.expr(REPAIR)), now(), 3)


@query("submitted_topics", f"""with {_A}, t as (select distinct topic, user_id % 5 as family from a), s as (select topic, user_id % 5 as family, ts from a where submitted and user_id % 3 = 0)
    select topic from t where topic in (select topic from s) or family in (select family from s where ts >= timestamp '{NOW}' - interval 1 day)""")
def submitted_topics(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("family", F.col("user_id") % 5)
    return supply.submitted_topics(a.select("topic", "family").distinct(), a.where("submitted and user_id % 3 = 0").select(F.concat(F.lit(" "), F.upper("topic")).alias("topic"), "family", "ts"), now(), 1)


TITLE = {"title": _cases("c_custkey", ["A Study — Full Paper", "Agent: a  Review", "Topic: Of Notes - full paper", "", "Plain"])}
_MARKERS = """case c_custkey % 5 when 0 then ['title:a study', 'title:a study — full paper'] when 1 then ['title:a review', 'title:agent: a review'] when 2 then ['title:of notes', 'title:of notes - full paper', 'title:topic: of notes', 'title:topic: of notes - full paper'] when 3 then []::varchar[] else ['title:plain'] end"""


@query("title_markers", f"select c_custkey, array_to_string({_MARKERS}, '|') as markers from customer")
def title_markers(spark, sf_dir):
    return derived(table(spark, sf_dir, "customer"), TITLE, "c_custkey").select("c_custkey", F.array_join(supply.title_markers(F.col("title")), "|").alias("markers"))


@query("published_topics", """with t as (select n_name as topic from nation), m as (select 'topic:' || lower(n_name) as k from nation where n_regionkey = 1 union select 'title:' || lower(n_name) from nation where n_regionkey = 2)
    select topic from t where 'topic:' || lower(topic) in (select k from m) or 'title:' || lower(replace(topic, '_', ' ')) in (select k from m) or topic in (select n_name from nation where n_regionkey = 3)""")
def published_topics(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    low = F.lower("n_name")
    marks = n.where("n_regionkey = 1").select(F.concat(F.lit("topic:"), low).alias("marker")).union(n.where("n_regionkey = 2").select(F.concat(F.lit("title:Part one: "), low)))
    return supply.published_topics(n.select(F.col("n_name").alias("topic")), marks, n.where("n_regionkey = 3").select(F.col("n_name").alias("topic")))


ASKED = [
    "Narrow the title, please", "Boilerplate in Methods", "The source is miscoded", "P-value missing", "nothing known", "Add the screening steps", "Give actionable steps", "This is indirect", "Claims are not traceable",
    "Reconcile the strongest signal", "An off-topic source", *[f"Please mend: {t.upper()} here" for terms in supply.REVISE_BUCKETS.values() for t in terms],
]


def asks(spark, sf_dir, *keep):
    """Events as asks: every phrase of every bucket in turn."""
    text = F.get(F.array(*map(F.lit, ASKED)), (F.col("event_id") % len(ASKED)).cast("int"))
    return table(spark, sf_dir, "events").select(*keep, text.alias("text"))


_TEXTS = ", ".join("'" + t.replace("'", "''") + "'" for t in ASKED)
_LOW = "regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')"
_BUCKET = "case " + " ".join(f"when {' or '.join('contains(low, ' + chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39) + ')' for t in terms)} then '{k}'" for k, terms in supply.REVISE_BUCKETS.items()) + " else 'unknown' end"
_ASKS = f"asks as (select *, {_BUCKET} as bucket from (select *, {_LOW} as low from (select event_id, user_id, event_type, ts, [{_TEXTS}][cast(event_id % {len(ASKED)} as int) + 1] as text from events)))"


@query("revise_reasons", f"""with {_ASKS}, e as (select event_id, user_id as review, ts, event_type, bucket from asks), n as (select distinct review from e where event_type = 'purchase')
    select review, bucket, count(*) as n from e where (event_type = 'purchase') or (event_type = 'view' and review not in (select review from n)) group by all""")
def revise_reasons(spark, sf_dir):
    """Views are asks that were known, purchases the news of their reviews."""
    e = asks(spark, sf_dir, "user_id", "event_type", "ts").select(F.col("user_id").alias("review"), F.col("ts").alias("at"), "text", "event_type")
    return supply.merged_asks(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"))


@query("revision_lessons", f"with {_ASKS} select bucket, count(*) as n from (select bucket from asks where ts >= timestamp '{NOW}' - interval 5 day) where bucket not in ('unknown', 'actionable_gaps') group by bucket order by n desc, bucket limit 4")
def revision_lessons(spark, sf_dir):
    e = asks(spark, sf_dir, "ts").select(supply.revise_bucket(F.col("text")).alias("bucket"), F.col("ts").alias("at"))
    return supply.lessons(e, now(), [b for b in supply.REVISE_BUCKETS if b != "actionable_gaps"], 5, 4)


@query("topic_points", f"""with {_A}, h as (select user_id, max(ts) as last, count(*) filter (where ts >= timestamp '{NOW}' - interval 1 hour and not submitted) as failures, count(*) as runs, count(*) filter (where value > 100) as certified from a group by user_id)
    select user_id, cast(round_even(certified / runs * 5, 0) as bigint) + case when last < timestamp '{NOW}' - interval 14 day then 2 else 0 end - 2 * failures as points, case when runs % 3 = 0 then runs else certified end as support from h""")
def topic_points(spark, sf_dir):
    a = attempts(spark, sf_dir)
    h = a.groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if((F.col("ts") >= now() - F.expr("interval 1 hour")) & ~F.col("submitted")).alias("failures"), F.count("*").alias("runs"), F.count_if(F.col("value") > 100).alias("certified"))
    return h.select("user_id", supply.publication_points(*_c("certified", "runs", "last", "failures"), now()).alias("points"), supply.support_points(F.when(F.col("runs") % 3 == 0, F.col("runs")), F.col("certified")).alias("support"))


_LEAST = {"receipts": 12, "primary_tier": 3, "direct_receipts": 2}
FIT = {"r": "o_orderkey % 20", "p": "o_orderkey % 5", "d": "o_orderkey % 4"}


@query("fit_rank", f"""with f as {derived_sql('orders', FIT, 'o_orderkey')}, g as (select *, greatest(0, 12 - r) as rg, greatest(0, 3 - p) as pg, greatest(0, 2 - d) as dg from f)
    select o_orderkey, case when r <= 0 then 3 when pg + dg > 0 then 2 when rg > 0 then 1 else 0 end as status, cast(case when r <= 0 then 12 else rg end as int) as receipt_gap, cast(case when r <= 0 then 12 else pg + dg end as int) as fit_gap, cast(case when r <= 0 then 3 else pg end as int) as primary_gap, cast(case when r <= 0 then 2 else dg end as int) as direct_gap,
      cast(case when r <= 0 then 0 else -d end as int) as direct, cast(case when r <= 0 then 0 else -p end as int) as "primary", cast(case when r <= 0 then 0 else -r end as int) as receipts from g""")
def fit_rank(spark, sf_dir):
    f = derived(table(spark, sf_dir, "orders"), FIT, "o_orderkey")
    return f.select("o_orderkey", supply.fit_rank(*_c("r", "p", "d"), _LEAST).alias("k")).select("o_orderkey", "k.*")


@query("preflight_counts", f"""with {_A}, l as (select topic, cast(ts as date) as ledger, max(ts) as s, arg_max(event_id, event_id) as last from a where {_LATE.replace('240', '48')} group by all), m as (select topic, arg_max(last, (s, ledger)) as e from l group by topic)
    select topic, e % 13 as receipts, e % 7 as primary_tier, e % 3 as direct_receipts from m""")
def preflight_counts(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("ledger", F.to_date("ts")).withColumns({"receipts": F.col("event_id") % 13, "primary_tier": F.col("event_id") % 7, "direct_receipts": F.col("event_id") % 3})
    return supply.preflight_counts(a, "topic", "ledger", "ts", "event_id", ["receipts", "primary_tier", "direct_receipts"], now(), 48)


@query("fresh_pool", f"""with {_A}, t as (select distinct topic, user_id from a), o as (select topic from t where user_id % 7 <> 0), f as (select distinct topic from a where {_LATE.replace('240', '1')}), x as (select topic from t where user_id % 2 = 0)
    select topic, 'some' as case_ from o where topic not in (select topic from f where topic not in (select topic from x)) union all select topic, 'none' from o""")
def fresh_pool(spark, sf_dir):
    a = attempts(spark, sf_dir)
    blocked, exempt = a.where("user_id % 7 = 0").select("topic"), a.where("user_id % 2 = 0").select("topic")
    failing = supply.recent_blocked(a.select("topic", F.lit("x").alias("code"), "ts"), now(), 1)
    some = supply.fresh_pool(a.select("topic"), blocked, failing, exempt).withColumn("case_", F.lit("some"))
    return some.union(supply.fresh_pool(a.select("topic"), blocked, a.select("topic"), exempt.where("false")).withColumn("case_", F.lit("none")))


@query("selected_topic", f"with {_A}, s as (select topic, count(*) as n, max(ts) as last from a group by topic) select topic, n from s order by n desc, last, topic limit 1")
def selected_topic(spark, sf_dir):
    s = attempts(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return supply.first_by(s, "topic", [-F.col("n"), F.col("last")]).select("topic", "n")


@query("gate_failures", f"with {_A} select topic, code, count(*) as failures from a where not submitted and code not in ('', 'eligible', 'submitted') group by all")
def gate_failures(spark, sf_dir):
    return supply.same_gate_failures(attempts(spark, sf_dir), "topic", "status", F.col("submitted"))


@query("topic_retries", f"with {_A}, k as (select *, {_CLASSES} as klass from a) select topic, count(*) filter (where not submitted and (klass like 'A%' or klass like 'C%')) as retries from k group by topic")
def topic_retries(spark, sf_dir):
    return supply.retries(attempts(spark, sf_dir).withColumn("klass", supply.failure_class(F.col("status"))), "topic", "klass", F.col("submitted"))


@query("source_precision", "with f as (select source, contains(lower(text), 'tion') as specific, n_chars > 3000 as core from documents) select source, count(*) filter (where specific) as hits, count(*) as files, count(*) filter (where specific) / count(*) >= 0.9 or count(*) filter (where core) >= 5 as passed, case when count(*) filter (where specific) / count(*) >= 0.9 then 'ratio' when count(*) filter (where core) >= 5 then 'scoped_floor' else 'low' end as how from f group by source")
def source_precision(spark, sf_dir):
    return supply.source_precision(table(spark, sf_dir, "documents"), "source", F.contains(F.lower("text"), F.lit("tion")), F.col("n_chars") > 3000, 0.9, 5)


CLAIMS = """case p_partkey % 5 when 0 then null when 1 then '[]' when 2 then '[{"binding_confidence": "none"}]' when 3 then '[{"binding_confidence": "none"}, {"binding_confidence": "partial"}]' else '[{}]' end"""


@query("usable_files", "select p_brand, count(*) filter (where p_partkey % 5 in (0, 3, 4)) as usable, count(*) as files from part group by p_brand")
def usable_files(spark, sf_dir):
    return supply.usable_files(table(spark, sf_dir, "part").select("p_brand", F.expr(CLAIMS).alias("claims")), "p_brand", "claims")


@query("source_floor", "select p_partkey, case when least(p_size, p_partkey % 40) < 12 then 'preflight_insufficient_corpus:n_receipts=' || least(p_size, p_partkey % 40) || ' < threshold 12' else 'eligible' end as status from part")
def source_floor(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", supply.source_floor(F.col("p_size").cast("long"), F.col("p_partkey") % 40).alias("status"))


CITING = {"text": "case o_orderkey % 5 when 0 then 'As in [1, 3] and [2].' when 1 then 'See PMID: 1002.' when 2 then 'In 10.1000/x3).' when 3 then 'Abel 2001 said.' else 'Nothing [9].' end"}
_CITED = "case o_orderkey % 5 when 0 then [1, 2, 3] when 1 then [2] when 2 then [3] when 3 then [1] else []::int[] end"


@query("cited_rows", f"select o_orderkey as id, unnest({_CITED}) as position from orders")
def cited_rows(spark, sf_dir):
    """Each customer has a bundle of three sources, which orders' texts cite."""
    o = derived(table(spark, sf_dir, "orders"), CITING, "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("bundle"), "text")
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bundle"), F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("cited_as"), F.lit(str(1000 + i)).alias("pmid"), F.lit(f"10.1000/X{i}").alias("doi")) for i, n in enumerate(("Abel 2001", "Baker 2002", "Clark 2003"), 1)])).alias("s")).select("bundle", "s.*")
    return supply.cited_rows(o, b)


@query("day_summary", "with l as (select cast(o_orderdate as date) as day, o_orderkey % 5 as s, o_orderkey % 3 as p from orders), d as (select cast(o_orderdate as date) as day, o_orderkey % 7 as s from orders where o_orderstatus = 'F') select cast(l.day as varchar) as day, greatest(max(l.s), coalesce((select max(d.s) from d where d.day = l.day), 0)) as submitted, max(l.p) as published from l group by l.day")
def day_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    l, d = o.select("day", (F.col("o_orderkey") % 5).alias("submitted"), (F.col("o_orderkey") % 3).alias("published")), o.where("o_orderstatus = 'F'").select("day", (F.col("o_orderkey") % 7).alias("submitted"))
    return supply.day_summary(l, "day", d).withColumn("day", F.col("day").cast("string"))


@query("triage", f"with {_A}, l as (select * from a order by ts desc, event_id desc limit 12) select coalesce(nullif(code, ''), 'unknown') as reason, count(*) as n from l group by 1 order by n desc, reason limit 8")
def triage(spark, sf_dir):
    a = attempts(spark, sf_dir).select("ts", "event_id", "code")
    return supply.triage(a, "ts", F.col("code"))


LEDGER = """case o_orderkey % 3 when 0 then concat('{"submitted_run": "r', cast(o_orderkey as string), '", "out_dir": "", "attempts": [{"submitted": 1, "out_dir": "a1"}, {"submitted": 0, "out_dir": "a2"}]}') when 1 then '{"candidate": {"run": "c1"}, "submissions": [{"submitted": 1, "candidate": {"run": "s1"}}, {"candidate": {"run": "s2"}}]}' else '{}' end"""


@query("ledger_runs", "select o_orderkey as ledger, unnest(case o_orderkey % 3 when 0 then ['r' || o_orderkey, 'a1'] when 1 then ['c1', 's1'] else []::varchar[] end) as run from orders")
def ledger_runs(spark, sf_dir):
    return supply.ledger_names(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ledger"), F.expr(LEDGER).alias("payload")))


# Rankings.
ITEM = {"ref": "l_orderkey * 10 + l_linenumber", "direct": "l_linenumber % 2 = 0", "tier": _cases("l_partkey", ["A1", "A2", "B", "C", "X"]), "role": _cases("l_suppkey", ["published_results", "review", "registered_pending", "published_protocol", "mechanistic", "odd"]), "year": "case when l_partkey % 9 = 0 then null else 1990 + l_partkey % 30 end", "n_claims": "l_partkey % 12", "directness": "case when l_linenumber % 2 = 0 then 'direct' else 'review' end", "claim_type": _cases("l_linenumber", ["p_value", "percentage", "mean_sd", "other", "ci"])}
_IT = f"i as {derived_sql('lineitem', ITEM, 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')}"
_ROLE = "case role when 'published_results' then 0 when 'review' then 1 when 'registered_pending' then 2 when 'published_protocol' then 3 when 'mechanistic' then 4 else 9 end"


def items(spark, sf_dir):
    return derived(table(spark, sf_dir, "lineitem"), ITEM, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("writer_ranking", f"with {_IT} select l_partkey, ref, row_number() over (partition by l_partkey order by not direct, case tier when 'A1' then 0 when 'A2' then 1 when 'B' then 2 when 'C' then 3 else 9 end, {_ROLE}, -coalesce(year, 0), ref) as place from i qualify place <= 16")
def writer_ranking(spark, sf_dir):
    return ranking.for_writer(items(spark, sf_dir), "l_partkey").select("l_partkey", "ref", "place")


@query("reader_ranking", f"with {_IT} select l_suppkey, ref, row_number() over (partition by l_suppkey order by case tier when 'A1' then 5 when 'A2' then 4 else 0 end desc, directness <> 'direct', n_claims desc, ref) as place from i qualify place <= 10")
def reader_ranking(spark, sf_dir):
    return ranking.for_readers(items(spark, sf_dir).withColumn("receipt", F.col("ref")), "l_suppkey", 10).select("l_suppkey", "ref", "place")


@query("top_claims", f"""with {_IT}, k as (select *, case claim_type when 'p_value' then 1 when 'percentage' then 2 when 'ci' then 4 when 'mean_sd' then 6 end as kind, row_number() over (partition by l_partkey, claim_type order by ref, l_suppkey) as f from i where l_partkey % 10 <> 3)
    select l_partkey, ref, l_suppkey, row_number() over (partition by l_partkey order by case when kind is not null and f = 1 then kind else 8 end, ref, l_suppkey) as place from k qualify place <= 5""")
def top_claims(spark, sf_dir):
    i = items(spark, sf_dir).withColumn("o", F.struct("ref", "l_suppkey"))
    return ranking.top_claims(i, "l_partkey", "o", 5, F.col("l_partkey") % 10 == 3).select("l_partkey", "ref", "l_suppkey", "place")


@query("extraction_order", "select doc_id from documents order by lang <> 'en', case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2 else 3 end, n_chars desc, doc_id limit 50")
def extraction_order(spark, sf_dir):
    pool = F.when(F.col("lang") == "en", "core").when(F.col("lang") == "fr", "adjacent").when(F.col("lang") == "de", "background").otherwise("other")
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("primary_trial"), pool.alias("pool"), F.col("n_chars").alias("score"), F.lit(0).alias("n_sources"), F.lit(0).alias("year"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("title"))
    return ranking.for_extraction(d, 50).select("doc_id")


_DIR = _cases("l_orderkey", ["positive", "positive", "null", "negative", "", "unclear", "mixed"])
SIGNAL = {"direction": f"case when l_suppkey % 4 = 0 then 'positive' when l_suppkey % 4 = 1 then {_cases('l_orderkey', ['positive', 'null', 'unclear'])} when l_suppkey % 4 = 2 then {_cases('l_orderkey', ['null', 'unclear', 'null'])} else {_DIR} end", "p": "case when l_suppkey % 3 = 0 then '' when l_linenumber % 2 = 0 and l_suppkey % 3 = 1 then 'p = 0.01' else 'p = 0.5' end"}
_SG = f"s as {derived_sql('lineitem', SIGNAL, 'l_suppkey')}, d as (select l_suppkey, coalesce(nullif(direction, ''), 'unclear') as d, p = 'p = 0.01' as sig, p <> '' as stat from s)"


@query("net_directions", f"with {_SG} select l_suppkey, case when min(d) = max(d) then min(d) when bool_or(d = 'mixed') or (bool_or(d = 'positive') and bool_or(d = 'negative')) then 'mixed' when bool_or(d = 'positive') then 'positive' when bool_or(d = 'negative') then 'negative' else 'unclear' end as net from d group by l_suppkey")
def net_directions(spark, sf_dir):
    return ranking.net_direction(derived(table(spark, sf_dir, "lineitem"), SIGNAL, "l_suppkey"), "l_suppkey", "direction")


@query("direction_cells", f"with {_SG} select l_suppkey, 'positive=' || count(*) filter (where d = 'positive') || ', negative=' || count(*) filter (where d = 'negative') || ', null=' || count(*) filter (where d = 'null') || ', mixed=' || count(*) filter (where d = 'mixed') || ', unclear=' || count(*) filter (where d = 'unclear') || ' (n=' || count(*) || ')' as cell from d group by l_suppkey")
def direction_cells(spark, sf_dir):
    return ranking.direction_cells(derived(table(spark, sf_dir, "lineitem"), SIGNAL, "l_suppkey"), "l_suppkey", "direction")


@query("signal_cells", f"""with {_SG}, g as (select l_suppkey, d, count(*) as k, count(*) filter (where sig) as sig, count(*) filter (where stat) as stat from d group by all), t as (select l_suppkey, sum(k)::bigint as n, arg_max(d, (k, d)) as top, max(k) as tk, sum(sig)::bigint as sig, sum(stat)::bigint as stat from g group by l_suppkey)
    select l_suppkey, case when top in ('positive', 'negative', 'mixed') then top || ' signal in ' || tk || '/' || n || ' sources' when sig > 0 then 'significant source statistic in ' || sig || '/' || n || ' sources; receipt-level direction coded ' || top when stat > 0 then 'reported statistic in ' || stat || '/' || n || ' sources; receipt-level direction coded ' || top
      when top = 'null' then 'no extracted directional signal in ' || tk || '/' || n || ' sources' else top || ' signal in ' || tk || '/' || n || ' sources' end as cell from t""")
def signal_cells(spark, sf_dir):
    s = derived(table(spark, sf_dir, "lineitem"), SIGNAL, "l_suppkey").withColumn("ps", F.filter(F.array("p"), lambda x: x != ""))
    return ranking.signal_cells(s, "l_suppkey", "direction", "ps")


@query("fill_rate", f"with {_SG.split(', d as')[0]} select l_suppkey, round(sum((direction not in ('', 'unknown'))::int + (p <> '')::int) / (count(*) * 2), 6) as rate from s group by l_suppkey")
def fill_rate(spark, sf_dir):
    return ranking.fill_rate(derived(table(spark, sf_dir, "lineitem"), SIGNAL, "l_suppkey"), "l_suppkey", ["direction", "p"])


@query("context_counts", "with c as (select case when contains(lower(text), 'tion the') then 'reading' when contains(lower(text), ' der ') then 'german' when contains(lower(text), ' de ') then 'romance' else '' end as context from documents) select context, count(*) as n from c where context <> '' group by context")
def context_counts(spark, sf_dir):
    return ranking.context_counts(table(spark, sf_dir, "documents"), F.col("text"), {"reading": ["tion the"], "german": [" der "], "romance": [" de "]})


@query("reconciled_funnel", f"""with {_IT} select unnest(['original_strict_high_confidence', 'candidate_partial_only', 'admitted_receipts', 'direct_receipts', 'primary_tier_receipts']) as stage, unnest([count(*) filter (where n_claims > 6), count(*) filter (where n_claims <= 6), count(*), count(*) filter (where directness = 'direct'), count(*) filter (where tier in ('A1', 'A2', 'B1'))]) as n from i""")
def reconciled_funnel(spark, sf_dir):
    i = items(spark, sf_dir)
    counts = i.groupBy(F.when(F.col("n_claims") > 6, "accepted_high_confidence").otherwise("candidate_partial_only").alias("stage")).agg(F.count("*").alias("n"))
    return ranking.reconciled_funnel(counts, i)


@query("topic_funnel", f"with {_IT}, r as (select s_suppkey as l_suppkey, max(s_name) as last_run from supplier group by all) select l_suppkey, count(*) as papers, count(*) filter (where n_claims > 0) as with_claims, sum(n_claims)::bigint as claims, count(*) filter (where role <> 'odd') as with_design, any_value(last_run) as last_run from i left join r using (l_suppkey) group by l_suppkey")
def topic_funnel(spark, sf_dir):
    i = items(spark, sf_dir).withColumn("design", F.when(F.col("role") != "odd", F.col("role")))
    return ranking.topic_funnel(i, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("run")), "l_suppkey")


@query("accepted_papers", "select c_custkey as paper from customer where (c_custkey % 3 = 0 and '10.1/' || c_nationkey in (select '10.1/' || s_nationkey from supplier where s_acctbal > 5000)) or (c_custkey % 3 = 1 and c_custkey % 50 in (select s_suppkey from supplier where s_acctbal < 0))")
def accepted_papers(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    text = lambda x: F.col(x).cast("string")
    papers = c.select(F.col("c_custkey").alias("paper"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("10.1/"), text("c_nationkey"))).alias("doi"), F.when(F.col("c_custkey") % 3 == 1, (F.col("c_custkey") % 50).cast("string")).alias("pmid"))
    receipts = s.where("s_acctbal > 5000").select(F.concat(F.lit("10.1/"), text("s_nationkey")).alias("doi"), F.lit("").alias("pmid")).union(s.where("s_acctbal < 0").select(F.lit(None).cast("string"), text("s_suppkey")))
    return ranking.accepted_papers(papers, receipts)


@query("paper_ids", "select p_partkey, coalesce(case when p_size % 4 = 0 then '10.1/' || p_size end, case when p_size % 3 = 0 then 'P' || p_size end, 'hit_' || p_partkey) as paper_id from part")
def paper_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    return p.select("p_partkey", ranking.paper_id(F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("10.1/"), size)), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("P"), size)), F.lit(""), F.col("p_partkey")).alias("paper_id"))


@query("topic_aliases", "select p_partkey, case when lower(p_brand) = lower(trim(p_type)) then p_brand else p_brand || '|' || trim(p_type) end || '|x' as aliases, case when p_size % 2 = 0 then 'adjacent,background,core' else 'adjacent,core' end as pools from part")
def topic_aliases(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lists = [F.array("p_brand", F.lit(" ")), F.array(F.upper("p_brand"), "p_type"), F.array(F.lit("x"), F.lit("X"))]
    return p.select("p_partkey", F.array_join(ranking.distinct_aliases(*lists), "|").alias("aliases"), F.array_join(ranking.extraction_pools(F.col("p_size") % 2 == 0), ",").alias("pools"))


@query("retrieval_params", """with m as (select o_orderkey, (['smoke', 'calibrated', 'exhaustive', 'snowball', 'odd'])[o_orderkey % 5 + 1] as mode, case when o_orderkey % 3 = 0 then 500 end as cap, case when o_orderkey % 4 = 0 then 10 end as page from orders)
    select o_orderkey, cast(case mode when 'odd' then null when 'smoke' then coalesce(cap, 100) else coalesce(cap, 200000) end as int) as cap, cast(case mode when 'odd' then null when 'smoke' then coalesce(page, 25) else coalesce(page, 100) end as int) as page, case mode when 'odd' then null else mode in ('calibrated', 'snowball') end as yield_stop, case mode when 'odd' then null else mode in ('calibrated', 'exhaustive') end as waves from m""")
def retrieval_params(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mode = F.get(F.array(*map(F.lit, ("smoke", "calibrated", "exhaustive", "snowball", "odd"))), (F.col("o_orderkey") % 5).cast("int"))
    p = ranking.retrieval_params(mode, F.when(F.col("o_orderkey") % 3 == 0, 500), F.when(F.col("o_orderkey") % 4 == 0, 10))
    return o.select("o_orderkey", p.alias("p")).select("o_orderkey", "p.cap", "p.page", "p.yield_stop", "p.waves")


_ASKED = [
    ("What does the evidence say about metformin and rapamycin for frailty in older adults?", ["metformin", "rapamycin"], ["frailty"], "older adults", [], None), ("Metformin vs placebo for glucose in type 2 diabetes with CKD", ["metformin", "placebo"], ["cardiometabolic"], "T2D", ["CKD"], None),
    ("Effects of exercise on muscle strength and memory", ["exercise"], ["muscle_function", "cognitive"], None, [], None), ("Is there anything?", [], [], None, [], None), ("Statins for survival in obese healthy adults", ["statins"], ["longevity"], "obesity", [], None),
    ("Effects of the evidence and exercise and Exercise on memory and muscle strength in people 65+", ["the evidence", "exercise"], ["cognitive", "muscle_function"], None, [], "65-120"), ("Statins for survival aged 60 to 40", ["statins"], ["longevity"], None, [], "40-60"),
    ("Statins for survival in people over 70", ["statins"], ["longevity"], None, [], "70-120"), ("Evidence on the and statins for people younger than 18", ["statins"], [], None, [], "0-18"),
]


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


def _by(values) -> str:
    return f"case o_orderkey % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


@query("questions", f"select o_orderkey, array_to_string({_by([_list(q[1]) for q in _ASKED])}, ',') as interventions, array_to_string({_by([_list(q[2]) for q in _ASKED])}, ',') as outcomes, {_by(['null' if q[3] is None else repr(q[3]) for q in _ASKED])} as people, array_to_string({_by([_list(q[4]) for q in _ASKED])}, ',') as comorbidities, {_by(['null' if q[5] is None else repr(q[5]) for q in _ASKED])} as ages from orders")
def questions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_by([f"'{q[0]}'" for q in _ASKED])).alias("q"))
    found = ranking.question(F.col("q"))
    return o.select("o_orderkey", *[F.array_join(found[k], ",").alias(k) for k in ("interventions", "outcomes", "comorbidities")], found["people"].alias("people"), F.array_join(found["age"], "-").alias("ages"))


@query("matched_topics", """with a as (select c_custkey as id, lower(c_mktsegment) as t from customer), p as (select n_name as topic, s from (select n_name, unnest([lower(n_name), case n_regionkey when 0 then 'building' when 1 then 'automobile' when 2 then 'household item' else 'furniture' end]) as s from nation))
    select id, topic, max(case when t = s then 3 when contains(s, t) then 1 end) as score from a join p on t = s or contains(s, t) group by all""")
def matched_topics(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.initcap("c_mktsegment"), F.lit("!")).alias("term"))
    names = F.when(F.col("n_regionkey") == 0, "Buildings").when(F.col("n_regionkey") == 1, "AUTOMOBILE").when(F.col("n_regionkey") == 2, "household items").otherwise("Furniture")
    packs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("topic"), F.explode(F.array("n_name", names)).alias("alias"))
    return ranking.matched_topics(asked, packs)


# Provenance.
def artifacts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("run"), F.lit("paper.md").alias("name"), F.col("text").alias("content"), F.col("source").alias("author"), F.array("lang").alias("reviewers"), F.lit("AAA").alias("verdict"), F.lit("2024-01-01").alias("made_at"))


@query("provenance_records", """select doc_id as run, '{"artifact":"paper.md","author_model":"' || source || '","generated_at":"2024-01-01","reviewer_models":["' || lang || '"],"run_id":' || doc_id || ',"schema_version":"1.0","sha256":"' || sha256(text) || '","verdict":"AAA"}' as record from documents""")
def provenance_records(spark, sf_dir):
    return records.provenance(artifacts(spark, sf_dir))


@query("provenance_verified", "select doc_id as run, doc_id % 7 <> 0 and doc_id % 11 <> 0 as intact from documents")
def provenance_verified(spark, sf_dir):
    """Records against artifacts of which some were changed and some lost."""
    a = artifacts(spark, sf_dir)
    now_ = a.where("run % 11 <> 0").withColumn("content", F.when(F.col("run") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return records.verified(records.provenance(a), now_)


@query("artifact_consistency", """select o_orderkey as run, array_to_string(list_filter([case when o_orderkey % 9 = 0 then 'paper_present' end, case when o_orderkey % 9 <> 0 and o_orderkey % 5 = 0 then 'submission_package_match' end, case when o_orderkey % 9 <> 0 and o_orderkey % 7 = 0 then 'export_match' end, case when o_orderkey % 4 = 0 then 'manifest_receipt_count' end, case when o_orderkey % 6 in (0, 1) then 'citation_registry_coverage' end], lambda x: x is not null), ',') as failures from orders""")
def artifact_consistency(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("# Paper\nline  \n"), k.cast("string"))
    runs = o.select(k.alias("run"), F.when(k % 9 != 0, text).alias("paper"), F.when(k % 5 == 0, F.lit("other")).when(k % 3 == 0, F.concat(F.lit("# Paper\r\nline\n"), k.cast("string"), F.lit("\n\n"))).alias("mirror"), F.when(k % 7 == 0, F.lit("cut")).alias("export"), (k % 4).alias("receipts"), F.lit("Abel 2001; Baker 2002").alias("references"))
    registry = o.where(k % 6 != 0).select(k.alias("run"), F.explode(F.array(F.lit("Abel 2001"), F.when(k % 6 == 1, F.lit("Clark 2003")).otherwise(F.lit("Baker 2002")))).alias("label"))
    return records.consistency(runs, registry).withColumn("failures", F.array_join("failures", ","))


@query("candidate_bindings", """select p_partkey, case when p_size % 5 <> 0 then sha256('{"corpus_hash":"' || sha256(p_brand) || '","receipt_set_hash":"' || sha256(p_type) || '","review_type":"map","topic":"' || p_name || '"}') end as candidate_id from part""")
def candidate_bindings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    code = F.when(F.col("p_size") % 5 == 0, "not a hash").otherwise("abcdef0123")
    return p.select("p_partkey", records.candidate_binding(F.col("p_name"), code, F.sha2("p_brand", 256), F.sha2("p_type", 256), F.lit("map"), F.lit("policy"))["candidate_id"].alias("candidate_id"))


@query("snapshot_drift", "select p_partkey, case when p_partkey % 5 = 0 then 'lost' when p_partkey % 7 = 0 then 'fields' when p_partkey % 3 = 0 then 'files' end as problem from part where p_partkey % 5 = 0 or p_partkey % 7 = 0 or p_partkey % 3 = 0")
def snapshot_drift(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    files = p.select("p_partkey", F.explode(F.array(F.lit("a"), F.col("p_name"))).alias("content"))
    later = p.where("p_partkey % 5 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, -1).otherwise(F.col("p_size")))
    other = files.withColumn("content", F.when((F.col("p_partkey") % 3 == 0) & (F.col("content") == "a"), "b").otherwise(F.col("content")))
    return records.drifted(records.snapshot(p, files, "p_partkey"), records.snapshot(later, other, "p_partkey"), "p_partkey")


_WORDS = "Longevity outcomes after sustained metformin"


@query("id_audit", """select c_custkey as row, unnest(case when c_custkey % 8 = 0 then ['record_missing'] else list_filter([case when c_custkey % 6 = 1 then 'title' end, case when c_custkey % 5 = 1 then 'doi' end, case when c_custkey % 6 = 2 and c_custkey % 5 <> 1 and c_custkey % 5 <> 2 then 'title_under_specified' end], lambda x: x is not null) end) as mismatch from customer where c_custkey % 10 <> 9""")
def id_audit(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    title = F.when(k % 6 == 1, "Something else entirely about zebra crossings").when(k % 6 == 2, "Longevity outcomes").otherwise(F.lit(_WORDS))
    rows = c.select(k.alias("row"), F.when(k % 10 == 9, "").otherwise(k.cast("string")).alias("pmid"), title.alias("title"), F.when(k % 5 == 1, "10.1000/other").when(k % 5 == 2, "https://doi.org/10.1000/X").alias("doi"))
    registry = c.where(k % 8 != 0).select(k.cast("string").alias("pmid"), F.lit(_WORDS).alias("title"), F.lit("10.1000/x").alias("doi"))
    return records.id_audit(rows, registry)


@query("frozen_retrieval", """with s as (select user_id, event_type as source, max(case event_id % 4 when 0 then 1 when 1 then 2 when 2 then 3 end) as k from events group by all), g as (select user_id, count(*) as sources, count(*) filter (where k = 3) as succeeded, count(*) filter (where k = 2) as failed, count(*) filter (where k = 1) as pending from s where k is not null group by user_id)
    select *, sources || ' enabled; ' || succeeded || ' succeeded; ' || failed || ' failed; ' || pending || ' enabled without a recorded outcome' as summary from g""")
def frozen_retrieval(spark, sf_dir):
    state = F.get(F.array(*map(F.lit, ("Enabled", "failed", " succeeded", "odd"))), (F.col("event_id") % 4).cast("int"))
    return records.frozen_retrieval(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("source"), state.alias("state")), "user_id")


@query("retained_sources", "select c_custkey as source, c_acctbal > 0 and c_custkey in (select o_custkey from orders where o_orderstatus = 'F') as included, case when c_acctbal > 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') then 'duplicate_source' when c_acctbal > 0 then 'kept' else 'poor' end as reason from customer")
def retained_sources(spark, sf_dir):
    log = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), (F.col("c_acctbal") > 0).alias("included"), F.when(F.col("c_acctbal") > 0, "kept").otherwise("poor").alias("reason"))
    return records.retained(log, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("source")), "duplicate_source")


@query("cost_ledger", "select event_type, round(sum(value), 6) as cost from events group by event_type")
def cost_ledger(spark, sf_dir):
    return records.costs(table(spark, sf_dir, "events"), "event_type", "value")


# Grouping sets and approximate aggregates, which roll-ups of ledgers use.
@query("priority_rollup", "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) as level from orders group by rollup (o_orderstatus, o_orderpriority)")
def priority_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@query("status_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def status_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("approximate_counts", "select event_type, count(*) as n, true as users_close, true as median_close from events group by event_type")
def approximate_counts(spark, sf_dir):
    """Distinct users and the median by sketches, held against the exact numbers: within a twentieth, and within 2 % of the ranks."""
    e = table(spark, sf_dir, "events")
    # Exact counts apart from the sketches: together each user of a type would have sketches of its own.
    near = e.groupBy("event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.02).alias("a"), F.percentile_approx("value", 0.5, 1000).alias("m"))
    users = e.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("user_id").alias("x"))
    near = near.join(users, "event_type")
    below = e.join(near.select("event_type", "m"), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("m")).cast("int")).alias("r"))
    return near.join(below, "event_type").select("event_type", "n", (F.abs(F.col("a") - F.col("x")) <= F.greatest(F.col("x") * 0.1, F.lit(1))).alias("users_close"), F.col("r").between(0.48, 0.52).alias("median_close"))
