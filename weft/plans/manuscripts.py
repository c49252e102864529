"""Queries of manuscript checks on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import claims, issues
from weft.plans.synthesis import _RENDERED, rendered
from weft.plans.tables import registrar, spread, table

QUERIES, SQL, query = registrar()


@query("line_issues", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n, text from documents),
    m as (select *, (string_split(text, chr(10)))[n + 1] as after, regexp_matches(line, '^\s*\|.*\|\s*$') as tab, regexp_matches(line, '^#{1,6} ') as head from l),
    c as (select doc_id as id, n as place, left(line, 120) as detail, 'unterminated_paragraph' as code, 'P2' as severity from m where not head and not tab and length(line) > 60 and not regexp_matches(trim(line), '[.!?:;)\]]$')
      union all select doc_id, n, left(line, 120), 'shouting', 'P2' from m where length(line) > 20 and line = upper(line) and regexp_matches(line, '[A-Z]')
      union all select doc_id, n, left(line, 120), 'menu_line', 'P2' from m where len(regexp_extract_all(line, ' \| ')) >= 5 and not tab)
    select * from c""")
def line_issues(spark, sf_dir):
    rows = issues.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return issues.issues(rows, "doc_id", F.col("n"), F.col("line"), issues.line_rules())


def sentence_rows(spark, sf_dir):
    """Rendered results, each with a stated significance."""
    says = F.when(F.col("l_linenumber") % 3 == 0, " Not significant.").when(F.col("l_linenumber") % 3 == 1, " Significant result.").otherwise(" The the end.")
    return rendered(spark, sf_dir, spread).select("l_orderkey", "l_linenumber", F.concat("sentence", says).alias("s"))


@query("sentence_issues", rf"""with {_RENDERED}, t as (select l_orderkey, l_linenumber, sentence || case l_linenumber % 3 when 0 then ' Not significant.' when 1 then ' Significant result.' else ' The the end.' end as s, l_linenumber * 7 / 100 as p from s)
    select l_orderkey as id, code, severity, l_linenumber as place, left(s, 120) as detail from (
      select *, 'significance_wording' as code, 'P1' as severity from t where l_linenumber % 3 = 0 and p < 0.05 union all select *, 'significance_overclaim', 'P1' from t where l_linenumber % 3 = 1 and p >= 0.05 union all select *, 'repeated_word', 'P2' from t where l_linenumber % 3 = 2)""")
def sentence_issues(spark, sf_dir):
    return issues.issues(sentence_rows(spark, sf_dir), "l_orderkey", F.col("l_linenumber"), F.col("s"), issues.sentence_rules(2026))


@query("document_issues", """with d as (select doc_id, text, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> '')) as n from documents)
    select doc_id as id, code, 'P2' as severity, n as place, left(text, 120) as detail from d, (select unnest(['thin', 'missing_results']) as code) where code = 'missing_results' or n < 200""".replace("\\\\", "\\"))
def document_issues(spark, sf_dir):
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0b]+"), lambda w: w != ""))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("n_words"))
    return issues.issues(d, "doc_id", F.col("n_words"), F.col("text"), issues.document_rules(("results",), 200))


@query("issue_summary", """with r as (select o_custkey, count(*) as counted, count(*) filter (where o_orderstatus = 'P') as u, case when count(*) > 12 then 5 else 3 end as level, count(*) + case when o_custkey % 10 = 0 then 1 else 0 end as stated from orders group by o_custkey)
    select o_custkey as id, (stated <> counted)::int + (u > 0)::int + (level >= 5 and u > 0)::int as p1, 0 as p2, array_to_string(list_filter([case when stated <> counted then 'count_mismatch' end, case when u > 0 then 'unresolved_review' end, case when level >= 5 and u > 0 then 'verdict_despite_failures' end], lambda x: x is not null), ',') as codes
    from r where stated <> counted or u > 0""")
def issue_summary(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("counted"), F.count_if(F.col("o_orderstatus") == "P").alias("u"))
    g = g.withColumn("level", F.when(F.col("counted") > 12, 5).otherwise(3)).withColumn("stated", F.col("counted") + (F.col("o_custkey") % 10 == 0).cast("int"))
    found = issues.issues(g, "o_custkey", F.lit(0), F.lit(""), issues.run_rules(F.col("level"), F.col("stated"), F.col("counted"), F.col("u")))
    return issues.summary(found).withColumn("codes", F.array_join("codes", ","))


@query("evidence_table_rows", "select s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey) as n, '| ' || s_name || ' | ' || s_nationkey || ' |' as row from supplier qualify n <= 5")
def evidence_table_rows(spark, sf_dir):
    return issues.rendered_tables(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", ["s_name", "s_nationkey"], 5)


@query("direction_mismatches", """with c as (select l_suppkey as outcome, case when l_tax > 0.05 then 'positive' when l_tax < 0.03 then 'negative' else 'null' end as d, count(*) as c from lineitem group by all), t as (select outcome, max(c) as b from c group by outcome),
    k as (select outcome, case when count(*) > 1 then 'mixed' else min(d) end as coded from c join t using (outcome) where c = b group by outcome) select outcome, case when s_acctbal > 0 then 'positive' else 'negative' end as stated, coded from k join supplier on s_suppkey = outcome where coded <> case when s_acctbal > 0 then 'positive' else 'negative' end""")
def direction_mismatches(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("outcome"), F.when(F.col("l_tax") > 0.05, "positive").when(F.col("l_tax") < 0.03, "negative").otherwise("null").alias("direction"))
    prose = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("outcome"), F.when(F.col("s_acctbal") > 0, "positive").otherwise("negative").alias("stated"))
    return issues.direction_mismatches(prose, r)


@query("sentence_split", r"select doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) as sentences from documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(claims.sentences(F.col("text"))).alias("sentences"))
