"""Numbers in prose that are used without their source, or as what they are not.

Manuscripts(id, text) are taken apart into paragraphs and sentences, numbers of a
registry or of claims are found by one automaton, and what an earlier sentence said is
carried along a paragraph by a window over bit masks of change words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.terms import find_terms

# Words of change, of absolute values, of thresholds and of references back.
CHANGE_WORDS = ("change", "improvement", "increase", "decrease", "difference", "delta", "reduction", "rise", "decline", "gain")
ABSOLUTE_PHRASES = (
    "falls below", "below the", "above the", "below clinically", "below threshold", "below thresholds", "remained below", "below clinically meaningful", "below clinically significant", "fell below", "below the cutoff",
    "below the cut-off", "below the threshold", "value of", "level of", "absolute", "indicates", "signals", "reflects",
)
THRESHOLD_MARKERS = (
    "threshold", "thresholds", "cutoff", "cut-off", "cut off", "clinical threshold", "clinically meaningful threshold", "minimal clinically important", "frailty threshold", "frailty cutoff", "mobility limitation", "mobility-limitation",
    "0.8 m/s", "0.6 m/s", "0.5 m/s", "1.0 m/s", "0.78 m/s", "below the cutoff", "below clinical", "below normative", "below the normative", "fall below", "falls below", "remained below", "compared to the threshold", "compared to clinical",
)
COMPARISONS = ("below the cutoff", "below clinical", "below normative", "below the normative", "fall below", "falls below", "remained below", "compared to the threshold", "compared to clinical", "minimal clinically important")
ANAPHOR = r"(?i)\bthis\s+\w+(?:\s+\w+)?\s+(?:value|figure|number|result|measurement|score|level|rate)\b"
THRESHOLD_WORDS = r"(?i)\b(?:below\s+(?:the|a)\s+\d|above\s+(?:the|a)\s+\d|threshold|cutoff|cut-off|frailty\s+(?:threshold|cutoff)|clinically\s+meaningful)\b"
SPEED = r"(?i)\b\d+(?:\.\d+)?\s*m/s\b"
UNIT = r"\d+\.?\d*\s*([a-zA-Z/μ]+)"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
#: Characters around a number in which a change word hedges it: in a sentence, in a paragraph.
NEAR, NEAR_IN_PARAGRAPH = 40, 60


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, phrases)))


def body_sentences(papers: DataFrame) -> DataFrame:
    """(id, at, sentence): prose before the references, without table rows."""
    prose = F.regexp_replace(F.split("text", r"(?m)^##\s+References\b", 2)[0], r"(?m)^[ \t]*\|.*$\n?", "")
    return papers.select("id", F.posexplode(F.split(prose, SENTENCE_END + r"|\n\n+")).alias("at", "sentence")).where(F.trim("sentence") != "")


def within(left: DataFrame, right: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """(left's columns): rows of left(by..., at, ...) that have a row of right(by..., at) at most `width` places away.

    An interval join by buckets of `width` places: a right row stands in its own bucket and
    the two beside it, so a left row meets only what is near.
    """
    bucket = F.floor(F.col(at) / max(width, 1))
    near = right.select(*by, F.col(at).alias("_there"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket")).distinct()
    met = left.withColumn("_bucket", bucket).join(near, [*by, "_bucket"]).where(F.abs(F.col(at) - F.col("_there")) <= width)
    return met.select(*left.columns).distinct()


def unsourced_background(papers: DataFrame, registry: DataFrame, supported: DataFrame, width: int | None = None) -> DataFrame:
    """(id, sentence_at, numeric, citation, snippet): numbers of registry(numeric, citation) in a manuscript's prose without their citation in the sentence.

    A number that supported(citation, numeric) gives a receipt cited in the same sentence
    is that receipt's and passes. With `width`, a citation within so many characters of the
    prose will do instead of one in the sentence. Each sentence counts once.
    """
    s = body_sentences(papers)
    hits = _hits_in(s, registry)
    named = hits.join(registry.select("numeric", "citation").distinct(), "numeric")
    if width is None:
        open_ = named.where(~F.contains("sentence", F.col("citation")))
    else:
        placed = s.withColumn("begin", F.coalesce(F.sum(F.length("sentence") + 1).over(W.partitionBy("id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        cited = find_terms(placed, ["id", "begin"], "sentence", registry, "citation").select("id", F.col("term").alias("citation"), (F.col("begin") + F.col("at")).alias("pos"))
        own = named.join(placed.select("id", F.col("at").alias("sentence_at"), "begin"), ["id", "sentence_at"]).withColumn("pos", F.col("begin") + F.col("first"))
        open_ = own.join(within(own.select("id", "citation", "pos"), cited, ["id", "citation"], "pos", width), ["id", "citation", "pos"], "left_anti")
    cites = find_terms(hits.select("id", "sentence_at", "sentence").distinct(), ["id", "sentence_at"], "sentence", supported, "citation")
    backed = cites.select("id", "sentence_at", F.col("term").alias("_c")).distinct().join(supported.select(F.col("citation").alias("_c"), "numeric").distinct(), "_c").select("id", "sentence_at", "numeric").distinct()
    return open_.join(backed, ["id", "sentence_at", "numeric"], "left_anti").select("id", "sentence_at", "numeric", "citation", F.substring(F.regexp_replace("sentence", r"^\s+|\s+$", ""), 1, 160).alias("snippet")).distinct()


def _hits_in(s: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, sentence_at, sentence, numeric, first) of numbers that no digit or point stands before."""
    found = find_terms(s.withColumnRenamed("at", "sentence_at"), ["id", "sentence_at", "sentence"], "sentence", registry, "numeric")
    return found.where(~F.col("before").rlike("[0-9.]")).groupBy("id", "sentence_at", "sentence", F.col("term").alias("numeric")).agg(F.min("at").alias("first"))


def word_mask(text: Column) -> Column:
    """Bit k says that the text holds change word k."""
    return sum((F.when(F.contains(text, F.lit(w)), F.lit(1 << k)).otherwise(0) for k, w in enumerate(CHANGE_WORDS)), F.lit(0))


def change_values(claims: DataFrame) -> DataFrame:
    """(numeric, mask) of claims(raw, sentence, confidence): numbers of high confidence whose sentence speaks of change, and in which words."""
    high = claims.where((F.col("confidence") == "high") & (F.coalesce(F.trim("raw"), F.lit("")) != ""))
    masked = high.withColumn("mask", word_mask(F.lower(F.coalesce("sentence", F.lit("")))))
    return masked.groupBy(F.trim("raw").alias("numeric")).agg(F.expr("bit_or(mask)").alias("mask")).where("mask > 0")


def _around(low: Column, numeric: Column, reach: int) -> Column:
    """The text `reach` characters to either side of a number's first place."""
    at = F.instr(low, F.lower(numeric)) - 1
    start = F.greatest(at - reach, F.lit(0))
    return F.substr(low, start + 1, at + F.length(numeric) + reach - start)


def change_misreads(papers: DataFrame, values: DataFrame) -> DataFrame:
    """(id, at, numeric): sentences that use a change_values() number as an absolute one, with none of its change words near it."""
    s = papers.select("id", F.posexplode(F.split("text", SENTENCE_END + r"|\n\n+")).alias("place", "sentence"))
    s = s.where(_any(F.lower("sentence"), ABSOLUTE_PHRASES))
    hits = find_terms(s, ["id", "place", "sentence"], "sentence", values, "numeric").select("id", "place", "sentence", F.col("term").alias("numeric")).distinct()
    own = hits.join(values, "numeric")
    near = word_mask(_around(F.lower("sentence"), F.col("numeric"), NEAR))
    return own.where(near.bitwiseAND(F.col("mask")) == 0).select("id", F.col("place").alias("at"), "numeric")


def _paragraphs(papers: DataFrame) -> DataFrame:
    """(id, para, text), without those of which half the lines or more are table rows."""
    rows = papers.select("id", F.posexplode(F.split("text", "\n\n")).alias("para", "text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    tabular = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("|")))
    return rows.where((F.size(lines) == 0) | (tabular * 2 < F.size(lines)))


def paragraph_misreads(papers: DataFrame, values: DataFrame) -> DataFrame:
    """(id, para, numeric): paragraphs that set a change number against a threshold of its unit, no change word near it; the first such number.

    Either a marker of that unit stands in the paragraph, or one exists at all and the paragraph compares. Limitations are left out.
    """
    p = _paragraphs(papers).where(~F.contains(F.lower("text"), F.lit("## limitations")))
    hits = find_terms(p, ["id", "para", "text"], "text", values, "numeric").select("id", "para", "text", F.col("term").alias("numeric")).distinct()
    low, unit = F.lower("text"), F.lower(F.regexp_extract("numeric", UNIT, 1))
    markers = F.array(*map(F.lit, THRESHOLD_MARKERS))
    any_marker = F.exists(markers, lambda m: F.contains(m, unit))
    here = F.exists(markers, lambda m: F.contains(m, unit) & F.contains(low, m))
    risk = (unit != "") & (here | (any_marker & _any(low, COMPARISONS)))
    bare = word_mask(_around(low, F.col("numeric"), NEAR_IN_PARAGRAPH)) == 0
    return hits.where(risk & bare).groupBy("id", "para").agg(F.min("numeric").alias("numeric"))


def anaphor_misreads(papers: DataFrame, values: DataFrame) -> DataFrame:
    """(id, para, at): sentences that hold "this ... value" against a threshold after a change number of the same paragraph, without its change words.

    Change numbers are those of values, and speeds that a manuscript gives in a sentence of
    change, from there on. What earlier sentences brought is carried as a bit mask by a window.
    """
    p = _paragraphs(papers).where(~F.trim("text").startswith("```"))
    s = p.select("id", "para", F.posexplode(F.split(F.trim("text"), SENTENCE_END)).alias("place", "sentence")).withColumn("own", word_mask(F.lower("sentence")))
    known = find_terms(s, ["id", "para", "place"], "sentence", values, "numeric").select("id", "para", "place", F.col("term").alias("numeric")).distinct().join(values, "numeric").select("id", "para", "place", "mask")
    speeds = s.select("id", "para", "place", "own", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(SPEED), F.lit(0)))).alias("numeric"))
    by = W.partitionBy("id", "numeric").orderBy("para")
    seen = speeds.withColumn("mask", F.expr("bit_or(own)").over(by.rangeBetween(W.unboundedPreceding, 0))).withColumn("before", F.coalesce(F.expr("bit_or(own)").over(by.rangeBetween(W.unboundedPreceding, -1)), F.lit(0)))
    told = seen.where("before > 0 or own > 0").select("id", "para", "place", "mask")
    brought = known.unionByName(told).groupBy("id", "para", "place").agg(F.expr("bit_or(mask)").alias("brought"))
    earlier = W.partitionBy("id", "para").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    carried = s.join(brought, ["id", "para", "place"], "left").withColumn("carried", F.expr("bit_or(brought)").over(earlier))
    back = F.col("sentence").rlike(ANAPHOR) & F.col("sentence").rlike(THRESHOLD_WORDS)
    return carried.where(F.col("carried").isNotNull() & back & (F.col("carried").bitwiseAND(F.col("own")) == 0)).select("id", "para", F.col("place").alias("at"))
