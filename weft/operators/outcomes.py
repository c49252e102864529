"""A study's own result sentences and the outcomes that they state.

`sentences` is a table function over sections: each sentence is a row with its section
and place. What follows filters those rows, cuts them into clauses, and reads an
endpoint, a direction and a p-value from each clause, all by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.spans import located, nearest
from weft.operators.claims import KINDS, claim_role
from weft.operators.matching import once

# Sections, headings that run into a sentence, marks of others' findings, cuts between clauses, hedges.
SECTIONS = ("abstract", "introduction", "methods", "results", "discussion", "conclusion")
RESULT_SECTIONS = ("abstract", "results", "conclusion")
ABBREVIATION = r"(?i)\b(vs|e\.g|i\.e|et al)\.(\s)"
P_VALUE_POINT = r"\b([Pp]\s*(?:<=|>=|[<>=≤≥])\s*0?)\.([ \t ]*[0-9])"
RUN_IN = r"([.!?])((?:Background|Objective|Methods|Results|Conclusion)[A-Z])"
OTHERS = (
    r"(?i)\[\s*\d+(?:\s*[,;\-–]\s*\d+)*\s*\]|\bet al\.|"
    r"\b(?:previous|prior|earlier|other|published)\s+(?:[\w-]+\s+){0,2}(?:stud(?:y|ies)|reports?|trials?|cohorts?|research|evidence)\b|"
    r"\bno evidence that\b"
)
OURS = r"(?i)\b(?:we|our|this study|present study)\b"
RESUMED = r"(?i);\s*however,?\s*(?=the (?:increase|decrease|improvement) was significant)"
CLAUSE_CUT = r"(?i);(?![^()]*\))|\b(?:but|whereas|while|however|yet)\b|,\s+with\s+|\s+and (?=(?:greater|lower|higher|smaller|increased|decreased|improved|reduced)\b)"
HEDGED = r"(?i)\b(?:may|might|could|hypothes\w*|baseline|previous|prior)\b"
P_COMPARISON = r"\b[Pp][_\-a-zA-Z]*\s*(<=|>=|[<>=≤≥]|:)\s*(\d+\.?\d*[eE][+-]?\d+|0?\.\d+|\d+\.\d+|\d+)"
TAG = r"</?[A-Za-z][^>]*>"
#: A quote of a source has so many characters at least.
QUOTE = 20
_CUT, _POINT = "\x01", "\x02"


def sentence_list(text: Column) -> Column:
    """Sentences: they end before white space and a capital or digit, or before a heading that runs in; points of abbreviations and p-values end none."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), ABBREVIATION, f"$1{_POINT}$2"), P_VALUE_POINT, f"$1{_POINT}$2")
    cut = F.regexp_replace(F.regexp_replace(kept, r"([.!?])\s+(?=[A-Z0-9])", f"$1{_CUT}"), RUN_IN, f"$1{_CUT}$2")
    whole = F.transform(F.split(cut, _CUT), lambda s: F.trim(F.regexp_replace(F.translate(s, _POINT, "."), r"^\s+|\s+$", "")))
    return F.filter(whole, lambda s: s != "")


def sentences(papers: DataFrame) -> DataFrame:
    """(paper, section, at, sentence) of papers(paper, section, text): every sentence of the sections that are read, references left out."""
    rows = papers.select("paper", F.lower("section").alias("section"), F.posexplode(sentence_list(F.regexp_replace("text", TAG, " "))).alias("at", "sentence"))
    return rows.where(F.col("section").isin(*SECTIONS))


def owned(sentence: Column, section: Column) -> Column:
    """The sentence is long enough to quote, names no other study, and stands where a study states its results (in the discussion only if it says "we")."""
    own = section.isin(*RESULT_SECTIONS) | ((section == "discussion") & sentence.rlike(OURS))
    return own & ~sentence.rlike(OTHERS) & (F.length(F.regexp_replace(sentence, r"\s+", " ")) >= QUOTE)


def has_number(sentence: Column) -> Column:
    """A numeric claim of any kind."""
    return sentence.rlike("|".join(f"(?:{p})" for p in KINDS.values()))


def result_sentences(papers: DataFrame, numeric: bool = True) -> DataFrame:
    """(paper, section, at, sentence): the effect sentences of a study's own abstract, results and conclusion; with a number, if `numeric`."""
    s = sentences(papers).where(F.col("section").isin(*RESULT_SECTIONS) & owned(F.col("sentence"), F.col("section")))
    s = s.where(claim_role(F.col("sentence"), F.col("section")) == "effect")
    return s.where(has_number(F.col("sentence"))) if numeric else s


def _order(section: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RESULT_SECTIONS)), section)


def excerpts(papers: DataFrame, numeric: bool = True, context: bool = False) -> DataFrame:
    """(paper, section, excerpt): result sentences, each once a paper, from the first section that has it.

    With `context`, one excerpt a section: from its first result sentence to its last, what stands between them included.
    """
    found = result_sentences(papers, numeric)
    if context:
        ends = found.groupBy("paper", "section").agg(F.min("at").alias("a"), F.max("at").alias("b"))
        s = sentences(papers).join(ends, ["paper", "section"]).where("at between a and b")
        parts = s.groupBy("paper", "section").agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("s"))
        found = parts.select("paper", "section", F.lit(0).alias("at"), F.array_join("s.sentence", " ").alias("sentence"))
    first = found.groupBy("paper", "sentence").agg(F.min_by("section", F.struct(_order(F.col("section")), "at")).alias("section"))
    return first.select("paper", "section", F.col("sentence").alias("excerpt"))


def source_verdict(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """claims(paper, claim, sentence) with `verdict`: kept, drop_surface_gate, or drop_unowned_result.

    A claim's sentence must end as one and be a whole sentence of its paper, and one of the paper's own.
    """
    s = sentences(papers)
    s = s.groupBy("paper", F.regexp_replace("sentence", r"\s+", " ").alias("_s")).agg(F.max(owned(F.col("sentence"), F.col("section")).cast("int")).alias("own"))
    key = F.regexp_replace(F.coalesce("sentence", F.lit("")), r"\s+", " ")
    met = claims.withColumn("_s", key).join(s, ["paper", "_s"], "left")
    verdict = F.when(F.col("own").isNull() | ~F.col("_s").rlike("[.!?]$") | (F.length("_s") < QUOTE), "drop_surface_gate").when(F.col("own") == 0, "drop_unowned_result").otherwise("kept")
    return met.select(*claims.columns, verdict.alias("verdict"))


#: Drop counters of a results table, in the order of its gates.
COUNTERS = ("n_total_claims", "drop_surface_gate", "drop_unowned_result", "n_admissible", "drop_off_topic_arm", "n_topic_matched", "drop_missing_canonical_citation", "n_meaningful")


def results_diagnostic(claims: DataFrame, by: list[str]) -> DataFrame:
    """Counts of claims(by..., verdict, admissible, on_topic, citation, meaningful) that each gate of a results table lets pass or drops."""
    sourced = F.col("verdict") == "kept"
    able = sourced & F.col("admissible")
    topical = able & F.col("on_topic")
    cited = topical & (F.coalesce(F.trim("citation"), F.lit("")) != "")
    counts = (F.lit(True), F.col("verdict") == "drop_surface_gate", F.col("verdict") == "drop_unowned_result", able, able & ~F.col("on_topic"), topical, topical & ~cited, cited & F.col("meaningful"))
    return claims.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in zip(COUNTERS, counts, strict=True)])


def endpoint_aliases(papers: DataFrame, endpoints: list[tuple[str, str]]) -> DataFrame:
    """(paper, aliases): abbreviations that a paper puts in brackets behind an endpoint, those of one endpoint only, as (alias, endpoint). A text that papers share is read once."""
    found = [_defined(name, p) for name, p in endpoints]
    defined = once(papers.select("text")).select("text", F.explode(F.array_distinct(F.concat(*found))).alias("d"))
    rows = papers.select("paper", "text").join(defined, "text").select("paper", "d").distinct()
    alone = rows.groupBy("paper", "d.alias").agg(F.min("d.endpoint").alias("endpoint"), F.countDistinct("d.endpoint").alias("n")).where("n = 1")
    return alone.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("alias", "endpoint"))).alias("aliases"))


def _defined(name: str, pattern: str) -> Column:
    hits = F.regexp_extract_all("text", F.lit(rf"(?i:{pattern})\s*\(([A-Z][A-Z0-9]{{1,7}})\)"), F.lit(1))
    return F.transform(hits, lambda a: F.struct(a.alias("alias"), F.lit(name).alias("endpoint")))


def outcome_claims(papers: DataFrame, endpoints: list[tuple[str, str]], directions: list[tuple[str, str]]) -> DataFrame:
    """(paper, section, clause, endpoint, direction, comparator, p, source_sentence): outcomes that a study's own result sentences state, a row a clause.

    endpoints and directions are (name, pattern) in order of preference, patterns without
    groups that are kept. A clause has the first endpoint of the list that it names, and the
    direction nearest to it, longer phrases before words in them. Hedged clauses and
    those of baselines or earlier work are left out, and so are clauses with p-values that
    cannot be told to be this outcome's: there must be one, the endpoint named once, and
    no other endpoint unless nothing changed. An endpoint may stand by an abbreviation
    that the paper defines. A section, or a sentence with its abbreviations, that papers
    share is read once.
    """
    aliases = endpoint_aliases(papers, endpoints)
    own = papers.select("paper", F.lower("section").alias("section"), "text").where(F.col("section").isin(*RESULT_SECTIONS))
    read = result_sentences(once(own.select(F.col("text").alias("paper"), "section", "text")), numeric=False).withColumnRenamed("paper", "text")
    s = own.join(read, ["text", "section"]).groupBy("paper", "sentence").agg(F.min_by("section", F.struct(_order(F.col("section")), "at")).alias("section"))
    s = s.join(aliases, "paper", "left").withColumn("_named", F.coalesce("aliases", F.array().cast("array<struct<alias:string,endpoint:string>>")))
    s = s.select("paper", "section", F.col("sentence").alias("source_sentence"), "_named")
    stated = _stated(once(s.select("source_sentence", "_named")), endpoints, directions)
    return s.join(stated, ["source_sentence", "_named"]).select("paper", "section", "clause", "endpoint", "direction", "comparator", "p", "source_sentence")


def _stated(sentences: DataFrame, endpoints: list[tuple[str, str]], directions: list[tuple[str, str]]) -> DataFrame:
    """(source_sentence, _named, clause, endpoint, direction, comparator, p) of outcome_claims() for distinct sentences(source_sentence, _named)."""
    spelt = F.aggregate("_named", F.col("source_sentence"), lambda t, a: F.regexp_replace(t, F.concat(F.lit(r"\b"), a["alias"], F.lit(r"\b")), a["endpoint"]))
    clauses = sentences.select("source_sentence", "_named", F.explode(F.split(F.regexp_replace(spelt, RESUMED, " "), CLAUSE_CUT)).alias("clause")).where(F.trim("clause") != "")
    c = F.col("clause")
    rank = F.coalesce(*[F.when(c.rlike(f"(?i){p}"), k) for k, (_, p) in enumerate(endpoints)])
    rows = clauses.withColumn("_k", rank).where(F.col("_k").isNotNull() & ~c.rlike(HEDGED))
    pattern = F.get(F.array(*[F.lit(f"(?i){p}") for _, p in endpoints]), F.col("_k"))
    rows = rows.withColumn("_raw", F.regexp_substr(c, pattern)).withColumn("_at", F.regexp_instr(c, pattern) - 1)
    for k, (_, p) in enumerate(directions):
        rows = rows.withColumn(f"_d{k}", located(c, f"(?i){p}"))
    moves = [f"_d{k}" for k in range(len(directions))]
    rows = rows.withColumn("_all", F.concat(*moves))
    outer = lambda a: ~F.exists("_all", lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & (b["end"] - b["start"] > a["end"] - a["start"]))
    rows = rows.withColumn("_d", nearest([F.filter(m, outer) for m in moves], F.col("_at"))).where(F.col("_d").isNotNull())
    # Other endpoints: each hit counts for the first endpoint of the list that covers its start.
    for k, (_, p) in enumerate(endpoints):
        rows = rows.withColumn(f"_e{k}", located(c, f"(?i){p}"))
    rows = rows.withColumn("_n", F.size(F.array_distinct(F.flatten(F.array(*[_winners(k, len(endpoints)) for k in range(len(endpoints))])))))
    found = F.regexp_extract_all(c, F.lit(P_COMPARISON), F.lit(0))
    sign, value = F.regexp_extract(c, P_COMPARISON, 1), F.expr(f"try_cast(regexp_extract(clause, r'{P_COMPARISON}', 2) as double)")
    once = F.size(F.split(F.lower(c), F.regexp_replace(F.lower("_raw"), r"([^a-z0-9 ])", r"\\$1"))) == 2
    move = F.get(F.array(*[F.lit(n) for n, _ in directions]), F.col("_d"))
    told = (F.size(found) == 1) & ((F.col("_n") == 1) | (move == "no_change")) & once & (value >= 0) & (value <= 1)
    kept = rows.withColumn("_p", told).where((F.size(found) == 0) | F.col("_p"))
    normal = F.when(sign == "≤", "<=").when(sign == "≥", ">=").when(sign == ":", "=").otherwise(sign)
    return kept.select(
        "source_sentence", "_named", F.trim("clause").alias("clause"), F.get(F.array(*[F.lit(n) for n, _ in endpoints]), F.col("_k")).alias("endpoint"), move.alias("direction"),
        F.when(F.col("_p"), normal).alias("comparator"), F.when(F.col("_p"), value).alias("p"),
    )


def _winners(k: int, n: int) -> Column:
    """For each hit of endpoint k, the first endpoint with a hit that covers the hit's start."""
    covers = lambda j, a: F.exists(f"_e{j}", lambda b: (b["start"] <= a["start"]) & (a["start"] <= b["end"]))
    return F.transform(f"_e{k}", lambda a: F.coalesce(*[F.when(covers(j, a), j) for j in range(n)]))
