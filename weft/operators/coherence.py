"""What a manuscript says of its own sources and statistics, held against what was saved."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.numerics import wording_mismatch

# How prose denies that there are sources of a kind.
NO_SOURCES = (r"(?i)\bno\s+([a-z][a-z-]+)\s+(?:sources?|studies)\b", r"(?i)\bno\s+sources?\s+(?:were\s+)?classified\s+(?:primarily\s+)?as\s+([a-z][a-z-]+)")


def denied_sources(papers: DataFrame, receipts: DataFrame) -> DataFrame:
    """(id, category, n): kinds of directness that papers(id, text) says no source has, and how many of receipts(id, directness) have it; a row for each time it says so."""
    said = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in NO_SOURCES])
    claims = papers.select("id", F.posexplode(F.transform(said, F.lower)).alias("claim", "category"))
    have = receipts.groupBy("id", F.lower("directness").alias("category")).agg(F.count("*").alias("n")).where(F.col("category") != "")
    return claims.join(have, ["id", "category"]).select("id", "claim", "category", "n")


def incoherent_sentences(papers: DataFrame) -> DataFrame:
    """(id, sentence): sentences before the references whose words and p-value disagree, each beginning of 80 characters once."""
    body = F.split("text", r"(?im)^##\s+References\b", 2)[0]
    s = papers.select("id", F.posexplode(F.split(body, r"(?<=[.!?])\s+")).alias("at", "sentence")).where(wording_mismatch(F.col("sentence")))
    first = s.groupBy("id", F.substring(F.trim("sentence"), 1, 80).alias("key")).agg(F.min_by("sentence", "at").alias("sentence"))
    return first.select("id", F.trim("sentence").alias("sentence"))


def consistency_counts(reports: DataFrame) -> DataFrame:
    """(id, issues, leaks) of reports(id, report as JSON): a list of issues or an object with one. Leaks are issues of paper ids in prose."""
    text = F.when(F.ltrim("report").startswith("["), F.col("report")).otherwise(F.get_json_object("report", "$.issues"))
    rows = F.coalesce(F.from_json(text, "array<struct<issue_type:string, id:string>>"), F.array().cast("array<struct<issue_type:string,id:string>>"))
    leak = lambda i: F.contains(F.coalesce(i["issue_type"], F.lit("")), F.lit("paper_id")) | F.contains(F.coalesce(i["id"], F.lit("")), F.lit("broken_paper_id"))
    return reports.select("id", F.size(rows).alias("issues"), F.size(F.filter(rows, leak)).alias("leaks"))


def stale_methods(papers: DataFrame, gate: str, phrases: list[str], aside: str = "What did NOT run") -> DataFrame:
    """(id, phrase, n): phrases of a gate in the Methods of papers(id, text, writer_path) whose writer did not run it; a subsection on what did not run is left out."""
    methods = F.regexp_extract("text", r"(?s)##\s+Methods(.*?)(?=\n##\s+\w|$)", 1)
    own = F.lower(F.regexp_replace(methods, rf"(?ms)^###\s+{re.escape(aside)}\b.*?(?=^### |\z)", ""))
    rows = papers.where(~F.contains(F.lower(F.coalesce("writer_path", F.lit(""))), F.lit(gate.lower()))).withColumn("_m", own)
    counts = F.array(*[F.struct(F.lit(p).alias("phrase"), (F.size(F.split("_m", re.escape(p))) - 1).alias("n")) for p in phrases])
    return rows.select("id", F.inline(counts)).where("n > 0")


def as_issues(rows: DataFrame, id_col: str, code: str, severity: str, evidence: Column) -> DataFrame:
    """(id, code, severity, evidence): mismatches of any kind as issues of one code."""
    return rows.select(F.col(id_col).alias("id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), evidence.alias("evidence"))


# A subject that a repair doubled, and values behind "no change".
DOUBLED = r"(?i)(?:the\s+)?([A-Za-z]+(?:\s+[A-Za-z]+)?)\s+group\s+\w+[^.]*?for\s+the\s+\1\s+group\s+(?:was|were|is)"
UNCHANGED = r"(?i)\bno\s+(?:meaningful\s+|clear\s+|significant\s+)?change\b[^.]{0,140}?\((?!\s*p\s*[<=>])([^)]*\d+\.?\d*[^)]*)\)"
VALUE = r"(?i)\b(\d+\.?\d*)\s*(?:m/s|kg|mg|%|mmhg|points?|scores?|units?)\b"


def doubled_subject(sentence: Column) -> Column:
    """`the X group ... for the X group was`: what a repair left."""
    return sentence.rlike(DOUBLED)


def changed_after_all(sentence: Column) -> Column:
    """A sentence of no change with a value of some unit, not zero, in brackets; p-values and confidence intervals are no such values."""
    inside = F.lower(F.regexp_extract(sentence, UNCHANGED, 1))
    value = F.regexp_extract(inside, VALUE, 1)
    return (inside != "") & ~F.contains(inside, F.lit("ci")) & ~F.contains(inside, F.lit("confidence interval")) & (value != "") & (value.try_cast("double") != 0)
