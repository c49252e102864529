"""Papers as wholes: what topic they belong to, their figures, claims and identities, and their rows of a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import normalize_doi

# A caption's label; candidates that a topic's tier allows.
FIGURE = r"(?im)^\s*(?:Figure|Fig\.?)\s+(\d+|[IVX]+)[.:]?\s*(.*)$"
CAPS = {"mainstream": 500, "adjacent": 350, "emerging": 250, "contested": 150, "pseudo": 0, "out_of_scope": 0}
#: Tiers in the order in which they are tried, with what each decides.
DECIDED = (("pseudo", "biomedical", "stop"), ("out_of_scope", "out_of_scope", "stop"), ("contested", "biomedical", "proceed"), ("mainstream", "biomedical", "proceed"), ("emerging", "biomedical", "proceed"))


def topic_class(name: Column, terms: Column, words: dict[str, list[str]]) -> Column:
    """struct(domain, tier, decision, cap) of a topic: the first tier of DECIDED with one of its words in the name or the terms; else adjacent, to proceed."""
    said = F.lower(F.concat_ws(" ", name, F.array_join(terms, " ")))
    says = lambda domain, tier, decision: F.struct(F.lit(domain).alias("domain"), F.lit(tier).alias("tier"), F.lit(decision).alias("decision"), F.lit(CAPS[tier]).alias("cap"))
    out = says("biomedical", "adjacent", "proceed")
    for tier, domain, decision in reversed(DECIDED):
        hit = F.lit(False)
        for w in words.get(tier, []):
            hit = hit | F.contains(said, F.lit(w))
        out = F.when(hit, says(domain, tier, decision)).otherwise(out)
    return out


def figures(texts: DataFrame) -> DataFrame:
    """(id, at, label, caption) of texts(id, text): lines that begin as a figure's caption, in order."""
    rows = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(FIGURE), F.lit(0))).alias("at", "line"))
    return rows.select("id", "at", F.concat(F.lit("Figure "), F.regexp_extract("line", FIGURE, 1)).alias("label"), F.trim(F.regexp_extract("line", FIGURE, 2)).alias("caption"))


def claim_artifacts(claims: DataFrame) -> DataFrame:
    """(paper, n, counts) of claims(paper, kind): how many claims a paper has, and of each kind as a map."""
    by_kind = claims.groupBy("paper", "kind").agg(F.count("*").alias("c"))
    return by_kind.groupBy("paper").agg(F.sum("c").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "c")))).alias("counts"))


def _identity(rows: DataFrame) -> DataFrame:
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.withColumns({
        "_doi": F.coalesce(normalize_doi(clean("doi")), F.lit("")), "_pmid": F.regexp_replace(clean("pmid"), "^0+", ""), "_pmcid": F.upper(clean("pmcid")), "_year": clean("year"),
        "_title": F.regexp_replace(F.lower(clean("title")), "[^a-z0-9]+", ""),
    })


IDS = ("_doi", "_pmid", "_pmcid")


def sources_unique(rows: DataFrame, by: str) -> DataFrame:
    """(by, unique): no two of rows(by, doi, pmid, pmcid, year, title) are one source.

    Two are if they share an identifier and conflict in none, or share a title, no
    conflicting identifier and no different year. Equal rows are counted first, so only
    rows that differ are compared, where they share a key.
    """
    fields = [*IDS, "_year", "_title"]
    own = _identity(rows).groupBy(by, *fields).agg(F.count("*").alias("_n")).withColumn("_id", F.xxhash64(*fields))
    keyed = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in (*IDS, "_title")]), lambda x: x["v"] != "")
    keys = own.select(by, *fields, "_id", F.explode(keyed).alias("_key"))
    left, right = keys.alias("a"), keys.alias("b")
    met = left.join(right, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a._key") == F.col("b._key")) & (F.col("a._id") < F.col("b._id")))
    both = lambda c: (F.col(f"a.{c}") != "") & (F.col(f"b.{c}") != "")
    conflict, shared = F.lit(False), F.lit(False)
    for c in IDS:
        conflict = conflict | (both(c) & (F.col(f"a.{c}") != F.col(f"b.{c}")))
        shared = shared | (both(c) & (F.col(f"a.{c}") == F.col(f"b.{c}")))
    titled = both("_title") & (F.col("a._title") == F.col("b._title")) & ~(both("_year") & (F.col("a._year") != F.col("b._year")))
    pairs = met.where(~conflict & (shared | titled)).select(F.col(f"a.{by}").alias(by)).distinct().withColumn("_pair", F.lit(True))
    some = (F.col("_doi") != "") | (F.col("_pmid") != "") | (F.col("_pmcid") != "") | (F.col("_title") != "")
    twice = own.groupBy(by).agg(F.bool_or((F.col("_n") > 1) & some).alias("_twice"))
    return twice.join(pairs, by, "left").select(by, (~F.col("_twice") & F.col("_pair").isNull()).alias("unique"))


def manifest_rows(receipts: DataFrame, registry: DataFrame) -> DataFrame:
    """receipts(run, receipt_id, author, year, ...) with citation_token: registry(run, receipt_id, body_citation)'s, else author and year."""
    cited = registry.select("run", "receipt_id", F.col("body_citation").alias("_c"))
    token = F.concat_ws(" ", F.nullif(F.trim(F.coalesce("author", F.lit(""))), F.lit("")), F.col("year").cast("string"))
    return receipts.join(cited, ["run", "receipt_id"], "left").select(*receipts.columns, F.coalesce("_c", token).alias("citation_token"))
