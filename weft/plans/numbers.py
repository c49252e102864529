"""Queries of numbers, their roles and their significance, over claims derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import numerics
from weft.plans.studies import _cases
from weft.plans.tables import derived, derived_sql, registrar, table

QUERIES, SQL, query = registrar()
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _c(*names):
    return [F.col(n) for n in names]


def lines(spark, sf_dir, columns, *keep):
    return derived(table(spark, sf_dir, "lineitem"), columns, *keep)


RAW = {"raw": _cases("p_partkey", ["5.0", "5", "0.050", ".5", "1,234 mg", "14%", "0.8 m/s", "n/a", "100", "007"])}


@query("numeric_variants", f"""with r as {derived_sql('part', RAW, 'p_partkey')}, n as (select *, case when raw like '.%' then '0' || raw else raw end as raw0 from r), k as (select *, regexp_extract(replace(raw0, ',', ''), '^([0-9]+(?:\\.[0-9]+)?)') as x, regexp_extract(raw0, '^[0-9]+\\.?[0-9]*') as bare from n),
    z as (select *, case when x <> '' then regexp_replace(case when contains(x, '.') then regexp_replace(x, '\\.?0+$', '') else x end, '^0+([0-9])', '\\1') end as key from k)
    select p_partkey, key, array_to_string(list_sort(list_distinct(list_filter([raw0, nullif(bare, ''), key, case when key is not null then case when contains(key, '.') then key else key || '.0' end end], lambda v: v is not null))), '|') as variants from z""")
def numeric_variants(spark, sf_dir):
    r = derived(table(spark, sf_dir, "part"), RAW, "p_partkey")
    return r.select("p_partkey", numerics.number_key(F.col("raw")).alias("key"), F.array_join(numerics.variants(F.col("raw")), "|").alias("variants"))


CLAIM = {
    "citation": "concat('Source', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(l_suppkey % 26 as int) + 1, 1), ' ', cast(1990 + l_suppkey % 30 as string))", "confidence": _cases("l_partkey", ["high", "partial", "none", "High", "partial"]),
    "claim_type": _cases("l_linenumber", ["p_value", "unit_value", "percentage", "sample_size", "hazard_ratio", "mean_sd"]), "role": _cases("l_partkey", ["baseline", "population", "change_score", "threshold", "dose", "effect", "outcome", "", "duration"]),
    "value": "concat(cast(cast(l_quantity as int) as string), ' mg')", "number": "cast(cast(l_quantity as int) as string)",
}
_CLAIM = f"c as {derived_sql('lineitem', CLAIM, *LINE)}"


@query("numeric_pools", f"""with {_CLAIM}, st as (select distinct number from c where lower(confidence) = 'high' or (confidence = 'partial' and claim_type in ('unit_value', 'sample_size'))), lo as (select distinct number from c where lower(confidence) in ('high', 'partial')),
    p as (select distinct o_custkey as id, o_orderpriority = '5-LOW' as in_table, cast(o_orderkey % 60 as varchar) as number from orders)
    select id, count(*) as numbers, count(*) filter (where number in (select number from st) and not in_table or in_table and number in (select number from lo)) as traced from p group by id""")
def numeric_pools(spark, sf_dir):
    """Numbers of each customer's orders, those of low priority as in a table, against the claims' pools."""
    c = lines(spark, sf_dir, CLAIM, *LINE)
    prose = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderpriority") == "5-LOW").alias("in_table"), (F.col("o_orderkey") % 60).cast("string").alias("number")).distinct()
    return numerics.traced(prose, numerics.pool(c, True), numerics.pool(c, False)).select("id", "numbers", "traced")


SAID = {
    "citation": CLAIM["citation"], "number": "cast(cast(l_quantity as int) as string)", "kind": "l_linenumber % 7",
    "s": """concat(case l_linenumber % 7 when 0 then 'We reported ' when 1 then 'Baseline speed was ' when 2 then 'There was a reduction of ' when 3 then 'Enrolled patients took part for ' when 4 then 'Patients aged ' when 5 then 'Values fell below ' else 'The dose was ' end, cast(cast(l_quantity as int) as string),
        case l_linenumber % 7 when 0 then ' in ' when 1 then ' m/s in ' when 2 then ' units in ' when 3 then ' months in ' when 4 then ' years joined ' when 5 then ' in ' else ' mg in ' end, 'Source', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(l_suppkey % 26 as int) + 1, 1), ' ', cast(1990 + l_suppkey % 30 as string), '.')""",
}
_MATCHES = " ".join(f"when '{k}' then list_has_any(roles, [{', '.join(repr(x) for x in v)}])" for k, v in numerics.COMPATIBLE.items())


@query("role_drift", f"""with {_CLAIM}, ix as (select citation, number, list(distinct case when role = '' then 'outcome' else role end) as roles from c where l_suppkey % 26 < 20 group by all),
    p as (select distinct l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey as id, citation, number, case kind when 0 then 'effect' when 1 then 'baseline' when 2 then 'change_score' when 3 then 'duration' when 4 then 'population' when 5 then 'threshold' else 'dose' end as role from {derived_sql('lineitem', SAID, *LINE)}),
    j as (select p.*, roles, citation in (select citation from ix) as known from p left join ix using (citation, number)), z as (select *, case role {_MATCHES} end as fits from j)
    select id, number, role, case when roles is null then 'value_drift' else 'role_drift' end as issue from z where known and (roles is null or not fits)""")
def role_drift(spark, sf_dir):
    """Sentences rendered from line items against the roles that their sources' numbers have; some sources are not registered."""
    index = numerics.role_index(lines(spark, sf_dir, CLAIM, *LINE).where("l_suppkey % 26 < 20"))
    said = lines(spark, sf_dir, SAID, *LINE).select(F.concat_ws(":", *LINE).alias("id"), "s")
    return numerics.role_drift(said, "id", "s", index).select("id", "number", "role", "issue")


P = {
    "p": _cases("o_orderkey", ["p = 0.03", "p=0.05", "P < 0.05", "p<=0.05", "p ≤ 0.04", "p > 0.05", "p >= 0.2", "p < 0.5", "none", "p = 1.2", "p > 0.01", "p<1e-5"]),
    "word": _cases("o_orderkey", ["not significant", "significant", "a trend toward benefit", "non-significant", "improved", "marginally better", "significant after Bonferroni correction"]),
}
_NOMINAL = r"""case when v < 0 or v > 1 then null when op = '=' then v < 0.05 when (op = '<' and v <= 0.05) or (op in ('<=', '≤') and v < 0.05) then true when op in ('>', '>=', '≥') and v >= 0.05 then false end"""


@query("significance_wording", f"""with s as (select *, regexp_extract(p, '{numerics.P_TEXT}', 1) as op, try_cast(nullif(regexp_extract(p, '{numerics.P_TEXT}', 2), '') as double) as v, 'It was ' || word || ' (' || p || ')' as s from {derived_sql('orders', P, 'o_orderkey')}), n as (select *, {_NOMINAL} as nominal from s),
    w as (select *, v is not null and not regexp_matches(s, '{numerics.ADJUSTED}') and ((regexp_matches(s, '{numerics.WEAK}') and coalesce(nominal, false) and (v < 0.01 or (op = '<' and v <= 0.01))) or (regexp_matches(s, '{numerics.NOT_SIGNIFICANT}') and coalesce(nominal, false)) or (regexp_matches(regexp_replace(s, '{numerics.NOT_SIGNIFICANT}', '', 'g'), '{numerics.SIGNIFICANT}') and not coalesce(nominal, true))) as bad from n)
    select o_orderkey, nominal, bad as mismatch from w""")
def significance_wording(spark, sf_dir):
    s = derived(table(spark, sf_dir, "orders"), P, "o_orderkey").withColumn("s", F.concat(F.lit("It was "), "word", F.lit(" ("), "p", F.lit(")")))
    return s.select("o_orderkey", numerics.nominal_significance(F.col("p")).alias("nominal"), numerics.wording_mismatch(F.col("s")).alias("mismatch"))


INDEX = {
    "endpoint": _cases("l_partkey", ["walk speed", "unknown", "duration", "dose", "body mass index", "mortality", "glucose", "egfr", "", "blood pressure", "frailty score"]), "role": _cases("l_suppkey", ["effect", "background", "dose", "population", "outcome"]), "claim_type": CLAIM["claim_type"], "confidence": CLAIM["confidence"],
    "direction": "case when l_partkey % 3 = 0 then '' else 'increase' end", "units": _cases("l_suppkey", ["mg", "years", "m/s", "mmHg", "", "kg", "%"]), "raw": _cases("l_partkey", ["p = 0.03", "95%", "12 mg", "00 mg", "4.5"]), "study": _cases("l_suppkey", ["Smith 2020", "Smith 2020ab", "Jones_2019_x", ""]),
    "s": _cases("l_partkey", ["Walk speed improved (p = 0.03); other outcomes were far from this and did not (p = 0.5)", "Groups were similar at baseline", "Heterogeneity was 40%", "A 95% CI was given", "Nothing", "The p = 0.03 in a long sentence about many other things and then finally p = 0.5"]),
}
_I = f"i as (select *, lower(endpoint) as e, lower(units) as u, lower(s) as ls from {derived_sql('lineitem', INDEX, *LINE)})"
_TYPES = "case claim_type when 'hazard_ratio' then 5 when 'sample_size' then 4 when 'p_value' then 3 when 'percentage' then 1 else 0 end"
_DENSE = r"""(len(regexp_extract_all(ls, '\bp\s*[<=>]\s*0?\.[0-9]+')) >= 2 and (instr(ls, lower(raw)) = 0 or len(w) = 0 or len(list_filter(w, lambda t: contains(substr(ls, greatest(instr(ls, lower(raw)) - 1 - 40, 0) + 1, instr(ls, lower(raw)) - 1 + length(raw) + 40 - greatest(instr(ls, lower(raw)) - 1 - 40, 0)), t))) = 0))"""


@query("index_rows", rf"""with {_I}, k as (select *, list_filter(regexp_extract_all(e, '[a-z0-9]+'), lambda t: length(t) >= 3 and t not in ('and', 'the', 'with')) as w from i),
    m as (select *, not (e in ('unknown', '') or role = 'background' or (claim_type = 'mean_sd' and role not in ('effect', 'outcome')) or (claim_type = 'p_value' and {_DENSE}) or (role = 'dose' and e <> 'dose') or (claim_type = 'sample_size' and role <> 'population') or (claim_type = 'hazard_ratio' and ((lower(confidence) <> 'high' and direction = '') or e = 'body mass index'))
      or (claim_type = 'unit_value' and u = 'years' and e <> 'duration') or (claim_type = 'unit_value' and u = 'mg' and e <> 'dose') or (contains(ls, 'baseline') and contains(ls, 'similar')) or (claim_type = 'percentage' and ((lower(raw) = '95%' and contains(ls, '95% ci')) or contains(ls, 'heterogeneity')))) as meaningful from k)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, lower(confidence) in ('high', 'partial') as admissible, meaningful, {_TYPES} + case when endpoint <> '' then 2 else 0 end + case when direction <> '' then 1 else 0 end as quality from m""")
def index_rows(spark, sf_dir):
    i = lines(spark, sf_dir, INDEX, *LINE)
    c = {"endpoint": "endpoint", "role": "role", "claim_type": "claim_type", "confidence": "confidence", "direction": "direction", "units": "units", "raw": "raw", "sentence": "s"}
    return i.select(*LINE, numerics.admissible(F.col("confidence")).alias("admissible"), numerics.meaningful({k: F.col(v) for k, v in c.items()}).alias("meaningful"), numerics.claim_quality(*_c("claim_type", "endpoint", "direction")).alias("quality"))


_UNITS = "case when u = '' then '' when regexp_matches(h, '\\bp\\s*[<=>]') then 'p_value' when contains(h, '%') then 'percentage' when u = 'mg' then 'dose' when contains(h, 'mmhg') then 'pressure' when contains(h, 'm/s') then 'speed' when regexp_matches(h, '\\byears\\b') then 'duration' when regexp_matches(h, '\\bkg\\b') then 'mass' else '' end"


@query("index_row_issues", f"""with {_I}, h as (select *, u || ' ' || lower(raw) as h from i), k as (select *, {_UNITS} as uc, case when e = 'mortality' then 'event' when e = 'blood pressure' then 'pressure' when e = 'body mass index' then 'bmi' when e = 'glucose' then 'biomarker' when e = 'egfr' then 'renal' when e = 'walk speed' then 'speed' when e = 'frailty score' then 'scale' else '' end as ec from h)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([case when e in ('', 'unknown') then 'endpoint' end, case when study like '%ab' or study like '%\\_x' escape '\\' then 'study' end, case when raw = '00 mg' then 'number' end,
      case when ec <> '' and uc <> '' and uc not in ('p_value', 'percentage') and not ((ec = 'pressure' and uc = 'pressure') or (ec = 'speed' and uc = 'speed')) then 'unit' end], lambda x: x is not null), ',') as issues from k""")
def index_row_issues(spark, sf_dir):
    i = lines(spark, sf_dir, INDEX, *LINE)
    return i.select(*LINE, F.array_join(numerics.row_issues(*_c("endpoint", "raw", "units", "study")), ",").alias("issues"))


@query("context_window", r"""with w as (select doc_id, text, n_chars % 500 as a, n_chars % 500 + 12 as b from documents) select doc_id, trim(regexp_replace(substr(text, greatest(a - 60, 0) + 1, least(b + 60, length(text)) - greatest(a - 60, 0)), '\s+', ' ', 'g')) as around from w where b <= length(text)""")
def context_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("a", F.col("n_chars") % 500).withColumn("b", F.col("a") + 12).where(F.col("b") <= F.length("text"))
    return d.select("doc_id", numerics.context_window(F.col("text"), F.col("a").cast("int"), F.col("b").cast("int")).alias("around"))
