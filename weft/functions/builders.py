"""Search-query builders: columns of a retrieval spec to query texts.

A spec has arrays topic_terms, scope_terms, evidence_types, exclude_terms and
languages, and integers date_from and date_to.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_group(terms: Column, tag: str = "", quote: bool = True) -> Column:
    """Terms joined by OR in parentheses; one stands bare, none is empty text."""
    clean = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    shown = F.transform(clean, lambda t: F.concat(F.when(F.lit(quote) & F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t), F.lit(tag)))
    joined = F.array_join(shown, " OR ")
    return F.when(F.size(shown) > 1, F.concat(F.lit("("), joined, F.lit(")"))).otherwise(joined)


def _and(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " AND ")


def pubmed_query() -> Column:
    dates = F.when(F.col("date_from").isNotNull(), F.concat(F.lit("("), F.col("date_from").cast("string"), F.lit("[dp] : "), F.coalesce(F.col("date_to").cast("string"), F.lit("3000")), F.lit("[dp])")))
    body = _and(or_group(F.col("topic_terms"), "[tiab]"), or_group(F.col("scope_terms"), "[tiab]"), or_group(F.col("evidence_types"), "[pt]"), or_group(F.col("languages"), "[lang]"), dates)
    out = or_group(F.col("exclude_terms"), "[tiab]")
    return F.when((out != "") & (body != ""), F.concat(body, F.lit(" NOT "), out)).otherwise(body)


def europepmc_query() -> Column:
    tagged = lambda c, k: or_group(F.transform(F.col(c), lambda t: F.concat(F.lit(f"{k}:"), t)), quote=False)
    years = F.when(F.col("date_from").isNotNull(), F.concat(F.lit("PUB_YEAR:["), F.col("date_from").cast("string"), F.lit(" TO "), F.coalesce(F.col("date_to").cast("string"), F.lit("3000")), F.lit("]")))
    return _and(or_group(F.col("topic_terms")), or_group(F.col("scope_terms")), tagged("evidence_types", "PUB_TYPE"), tagged("languages", "LANG"), years)


def keyword_query() -> Column:
    return _and(or_group(F.col("topic_terms")), or_group(F.col("scope_terms")))


def fulltext_query() -> Column:
    """All terms once, in any case, without operators."""
    terms = F.concat("topic_terms", "scope_terms")
    firsts = F.filter(F.transform(terms, lambda t, i: F.when(F.array_position(F.transform(terms, lambda x: F.lower(x)), F.lower(t)) == i + 1, t)), lambda t: t.isNotNull())
    return F.array_join(firsts, " ")


def query_for(source: Column) -> Column:
    """By connector; keyword where there is no builder of its own."""
    return F.when(source == "pubmed", pubmed_query()).when(source.isin("europepmc", "biorxiv", "medrxiv", "pmc_oai"), europepmc_query()).when(source == "fulltext", fulltext_query()).otherwise(keyword_query())


def waves() -> Column:
    """A spec's waves: precision with all of it, recall without evidence types, background with its allowed scope."""
    spec = lambda label, scope, kinds: F.struct(F.lit(label).alias("label"), F.col("topic_terms"), scope.alias("scope_terms"), kinds.alias("evidence_types"))
    none = F.array().cast("array<string>")
    return F.filter(
        F.array(spec("precision", F.col("scope_terms"), F.col("evidence_types")), F.when(F.size("evidence_types") > 0, spec("recall", F.col("scope_terms"), none)), F.when(F.size("background") > 0, spec("background", F.col("background"), none))),
        lambda w: w.isNotNull(),
    )


def plan_terms(topic: Column, domain: Column, stop: list[str]) -> Column:
    """The topic and the domain's tokens that are no stop words; null without a topic."""
    kept = F.filter(F.regexp_extract_all(F.lower(F.coalesce(domain, F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda t: ~t.isin(*stop))
    return F.when(F.trim(topic) != "", F.trim(F.concat_ws(" ", F.trim(topic), F.array_join(kept, " "))))
