"""Checks of manuscripts by section, paragraph and sentence, as rules of the issue table.

A manuscript is one row; its sections are columns cut from its text, and its
paragraphs and sentences rows exploded from it. Rules of one level are one
projection (see issues.issues). Rules that hold a text against sources are joins on
the citations that the text names.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import any_of
from weft.operators.issues import Rules
from weft.operators.numerics import HEDGES
from weft.operators.studies import outcome_key

# Headings, floors of words, and phrases that rules look for.
SECTIONS = ("Abstract", "Introduction", "Background", "Methods", "Results", "Cross-Domain Synthesis", "Discussion", "Limitations", "Conclusion", "References")
FLOORS = {"Abstract": 150, "Introduction": 400, "Background": 300, "Methods": 300, "Results": 400, "Cross-Domain Synthesis": 850, "Discussion": 800, "Limitations": 250, "Conclusion": 180}
THIN_FLOORS = {"Abstract": 100, "Methods": 200, "Results": 200, "Limitations": 80, "Conclusion": 80}
CEILINGS = {"Abstract": 300}
DEPTH = 800
APPENDIX = r"(?m)^##\s+(?:Publication Appendix|Data and Code Availability|Search Provenance|AI(?:-Use)? Disclosure|Accountability|References)\b"
AUTHOR_YEAR = r"\b(?:[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’.\-]+|[A-Z]{2,})(?:\s+et\s+al\.)?\s+(?:19|20)\d{2}[a-z]?\b"
JARGON = (
    "source-bound observation", "source-bound claim", "source-bound", "claim atom", "endpoint proximity", "accepted receipt graph", "accepted corpus", "accepted receipts", "accepted receipt", "mechanistic receipts", "direct clinical receipts", "indirect clinical receipts",
    "final receipt admission", "receipt admission funnel", "receipt-funnel", "receipt candidates", "receipt candidate", "receipt set", "receipt graph", "receipts", "n_claims", "structured corpus synthesis",
)
NOVELTY = r"(?i)\b(we\s+propose|novel\s+(?:framework|approach|method|model)|we\s+introduce|(?:our|this)\s+(?:novel|distinct)\s+contribution|first\s+to\s+(?:propose|introduce|operationalize|formalize))\b"
LEAKED_SUMMARY = (
    r"(?i)\bpositive\s+signals?\s+appear\s+in\b|\bnegative\s+signals?\s+appear\s+in\b|\bnull\s+findings?\s+dominate\b|\bthe\s+evidence\s+base\s+for\b.{0,80}\b(?:shows?|suggests?|supports?|indicates?|demonstrates?)\b"
    r"|\bthe\s+strongest\s+unresolved\s+contrast\b|\bacross\s+\d+\s+curated\s+reference\s+papers?\b|\bIt\s+separates\s+endpoint[- ]specific\s+evidence\b"
)
ALWAYS_P1 = r"(?i)\bit is clear that\b|\bundeniably\b|\bundoubtedly\b|\bproves that\b|\bclearly demonstrates\b|\bdefinitively shows\b"
ALWAYS_P2 = r"(?i)\bfurther research is needed\b|\bmore studies are needed\b|\bmore research is needed\b|\badditional research is warranted\b|\bfurther studies are warranted\b|\bthis synthesis suggests\b|\bin conclusion\s*,|\btaken together\s*,|\bin summary\s*,|\bthis review suggests\b"
VAGUE = r"(?i)\bevidence base is limited\b|\bthe literature is limited\b|\blimited evidence base\b"
MEASURE = r"(?i)\b(?:n\s*=|p\s*[<>=]|years?|months?|weeks?|days?|hours?|mg|ng|kg|ml|percent|hba1c|bmi|patients?|participants?|subjects?|trials?|studies|cohorts?|samples?|arms?|gait|grip|mortality|incidence|reduction|increase|rcts?|cis?)\b|%"
FABRICATED = ("two researchers", "manually reviewed", "manual review", "verified by two", "researchers verified", "consensus was reached", "discussed and resolved", "domain expert", "expert reviewed")
POLARITY = r"(?i)decreased\s+lifespan\s+by\s+\d|lifespan\s+(?:was\s+)?reduced\s+by\s+\d|shortened\s+lifespan\s+by\s+\d"
PRECLINICAL = r"(?i)\b(?:mice|rats?|C\.\s*elegans|mouse\s+models?|preclinical|animal\s+models?|in\s+vitro|cell\s+culture)\b"
TRANSLATION = (
    "humans", "translation", "translate", "extrapolat", "may not apply", "may not manifest", "remains to be", "warrant", "caution", "uncertain", "context-dependent", "speculative", "mechanistic evidence", "limit",
    "preclinical", "in mice", "in animals", "animal model", "model organism", "in rodents", "rat", "murine", "mouse", "c. elegans", "drosophila", "zebrafish", "in vitro", "ex vivo", "cell culture", "rodent",
)
FRAMEWORKS = r"(?i)\b(?:RoB-2|RoB 2|ROBINS-I|AMSTAR-2|AMSTAR 2)\b"
UNRESOLVED_STATISTIC = (
    r"(?i)\b(?:(?:exact\s+)?(?:statistic|effect estimate|p[- ]?value|confidence interval)\s+(?:is\s+|was\s+)?(?:unavailable|unknown|not\s+(?:available|reported|retained|extracted|extractable))"
    r"|(?:retained\s+)?source excerpt\s+(?:does not|did not|cannot)\s+(?:contain|include|report|retain)\s+(?:the\s+)?(?:exact\s+)?(?:statistic|effect estimate|p[- ]?value|confidence interval))\b"
)
HUMAN_CHECKED = r"(?i)\b(?:(?:author|human)[- ](?:verified|reviewed)|(?:author|human) verification|verified by (?:the )?(?:author|human))\b"
TEMPLATE_SLOT = r"(?i)\b(?:source|study|trial|paper)\((?:s|es)\)|\bstudy/studies\b"
CITATION_ARTIFACT = r"(?im)\[(?:citation needed|source|ref|pmid|doi|TODO)[^\]]*\]|(?:^|\s)(?:PMID|DOI):?\s*$|<\s*(?:citation|ref)[^>]*>"
GRAMMAR = (
    r"(?i)(?:\b(?:(?:is|are|was|were)\s+\w+(?:\s+\w+){0,3}\s+to\s+(?:is|are|was|were)|to\s+be(?:\s+\w+){0,5}\s+(?:is|are|was|were)|does\s+not\s+automatically\s+(?:is|are|was|were))\b|(?<=[A-Za-z])\.g\.,)"
)
HEDGE_FRAGMENT = r"(?i)^(?:may|might|could|appears|suggests|uncertain|preliminary|context[- ]dependent|not definitive|requires confirmation)\.?$"
CITATION_STUB = r"^(?:[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’.\-]+|[A-Z]{2,})(?:\s+et\s+al\.)?\s+(?:19|20)\d{2}[a-z]?\s+(?:reported|showed|found|observed|demonstrated|concluded)\.?$"
ANALYTIC_STUB = r"(?i)^(?:meta-analytic evidence corroborates|mechanistically,|mechanistic(?:al)? evidence|evidence corroborates|findings corroborate)"
CUT_OFF = r"(?i)(?:\.\.\.|…)$|\b(?:versus|vs|and|or|but|of|to|with|for|than|between|whereas|while)$"
TIER_LABEL = r"\b[ABCD][12]_[A-Za-z]+"
HANDLE = r"\b[A-Z][a-zA-Z]+_\d{4}_[A-Za-z_]+_|\bPMC\d{7,9}\b"
LANE_WORDS = (
    "animal", "preclinical", "rodent", "murine", "in vivo", "model organism", "veterinary", "non-human", "equine", "equid", "primate", "macaque", "horse", "swine", "porcine", "canine", "ovine", "mouse", "mice", "rat", "rats", "dog", "cat", "pig", "in vitro", "cell line", "transgenic", "knockout", "knock-out", "wild-type",
)
SELF_CLAIMS = (
    "we conducted", "we performed", "we undertook", "we report", "we present a", "we registered", "this is a", "this paper is", "this review is", "this synthesis is", "this study is", "this analysis is",
    "registered with prospero", "following prisma", "prisma-compliant", "prisma 2020 compliant", "our systematic review", "our meta-analysis", "our scoping review",
)
STRONGER = {
    "curated_evidence_map": ("systematic review", "scoping review", "meta-analysis", "meta analysis", "prospero", "prisma"),
    "prisma_scr_scoping_synthesis": ("systematic review", "meta-analysis", "meta analysis", "prospero", "prisma 2020"),
    "structured_evidence_synthesis": ("systematic review", "meta-analysis", "meta analysis", "prospero", "prisma 2020", "prisma-scr"),
    "narrative_review": ("systematic review", "scoping review", "meta-analysis", "meta analysis", "prospero", "prisma"),
    "evidence_brief": ("systematic review", "scoping review", "meta-analysis", "meta analysis", "prospero", "prisma"),
    "evidence_map": ("systematic review", "scoping review", "meta-analysis", "meta analysis", "prospero", "prisma"),
    "technical_survey": ("systematic review", "meta-analysis", "meta analysis", "prisma"),
    "management_literature_review": ("systematic review", "meta-analysis"),
    "systematic_review": (),
    "meta_analysis": (),
}


def slug(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def section(text: Column, name: str) -> Column:
    """The text below a second-level heading; null without the heading."""
    pattern = rf"(?ms)^##[ \t]+{name}\b[^\n]*(?:\n(.*?))?(?=^##[ \t]|\z)"
    return F.when(F.contains(text, F.lit(name)) & text.rlike(rf"(?m)^##[ \t]+{name}\b"), F.coalesce(F.regexp_extract(text, pattern, 1), F.lit("")))


def words(text: Column) -> Column:
    """Number of words that are not in table rows."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^[ \t]*\|.*$", " ")
    return F.size(F.array_remove(F.split(plain, r"\s+"), ""))


def manuscripts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, body, a column for each section): body ends before the appendix and the references."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = F.get(F.split(text, APPENDIX, 2), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), body.alias("body"), *[section(text, s).alias(slug(s)) for s in SECTIONS])


def paragraphs(papers: DataFrame) -> DataFrame:
    """(id, n, p) of the papers' bodies, from 1, white space collapsed."""
    parts = F.transform(F.split("body", r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return papers.select("id", F.posexplode(parts).alias("i", "p")).select("id", (F.col("i") + 1).alias("n"), "p").where("p <> ''")


def sentences(papers: DataFrame, column: str = "body") -> DataFrame:
    """(id, n, s, after) of a column's sentences from 1, each with the next one; headings and table rows are left out."""
    prose = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?m)^[ \t]*(?:#|\|).*$", "")
    arr = papers.select("id", F.filter(F.split(prose, r"(?<=[.!?])\s+|\n\s*\n"), lambda s: F.trim(s) != "").alias("a"))
    return arr.select("id", F.posexplode("a").alias("i", "s"), "a").select("id", (F.col("i") + 1).alias("n"), F.trim("s").alias("s"), F.coalesce(F.get("a", F.col("i") + 1), F.lit("")).alias("after"))


def _rows_of(results: Column) -> Column:
    """Cells of the rows below a table head that begins with "outcome class"."""
    table = F.regexp_extract(results, r"(?im)^\|[ \t]*outcome class[ \t]*\|[^\n]*\n\|[^\n]*\n((?:\|[^\n]*(?:\n|\z))+)", 1)
    lines = F.filter(F.split(table, "\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.transform(F.split(F.btrim(F.trim(x), F.lit("|")), r"\|"), lambda c: F.trim(c)))


def _parts_of(results: Column) -> Column:
    """struct(key, body) of third-level headings that end in "Outcomes"."""
    blocks = F.filter(F.split(results, r"(?m)^(?=###[ \t])"), lambda b: b.rlike(r"^###[ \t]+[^\n]*\bOutcomes?[ \t]*(?:\n|\z)"))
    return F.transform(blocks, lambda b: F.struct(outcome_key(F.regexp_extract(b, r"^###[ \t]+([^\n]*)", 1)).alias("key"), F.regexp_extract(b, r"(?s)^[^\n]*\n(.*)", 1).alias("body")))


def _repeats(w: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Whether some of a text's words, not all alike, are followed by themselves. The words are a column: what is made here would be made anew at each place."""

    def twice(k: int) -> Column:
        places = F.when(F.size(w) >= 2 * k, F.sequence(F.lit(1), F.size(w) - (2 * k - 1))).otherwise(F.array().cast("array<int>"))
        return F.exists(places, lambda i: (F.slice(w, i, k) == F.slice(w, i + k, k)) & (F.size(F.array_distinct(F.slice(w, i, k))) > 1) & ~F.element_at(w, i + (k - 1)).isin("and", "or"))

    found = F.lit(False)
    for k in sizes:
        found = found | twice(k)
    return (F.size(F.array_distinct(w)) < F.size(w)) & found


def _with_disclaimer(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a sentence holds a phrase and does not deny it."""
    said = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\.")
    return F.exists(said, lambda s: any_of(s, list(phrases)) & ~F.contains(s, F.lit("no manual")) & ~F.contains(F.substring(s, 1, 30), F.lit("not")))


def judged(papers: DataFrame) -> DataFrame:
    """manuscripts() with what rules use more than once: tables, parts, blocks, words and lower case of a paper."""
    results, abstract = F.coalesce("results", F.lit("")), F.coalesce("abstract", F.lit(""))
    counted = F.filter(F.transform("_rows", lambda r: F.struct(outcome_key(r[0]).alias("k"), F.regexp_extract(F.coalesce(F.get(r, F.lit(1)), F.lit("")), r"(?i)\bn\s*=\s*(\d+)\b", 1).alias("n"))), lambda s: s["n"] != "")
    claims = lambda b: F.regexp_extract_all(F.substring(b, 1, 900), F.lit(r"(?i)\b(?:spans|contains|includes|covers|across)\s+(\d+)\s+(?:curated\s+)?(?:references?|sources?|studies|papers)\b"), 1)
    made = papers.withColumns({"_rows": _rows_of(results), "_parts": _parts_of(results), "_blocks": F.filter(F.split("body", r"(?m)^(?=#{2,6}[ \t]+\S)"), lambda b: b.rlike(r"^#{2,6}[ \t]")), "_rest": F.lower(F.replace(F.col("body"), abstract, F.lit("")))})
    count = {f"_n_{c}": words(F.col(c)) for c in ("text", "body", "discussion", "cross_domain_synthesis")}
    made = made.withColumns({"_low": F.lower("text"), "_said": F.lower(F.coalesce("discussion", F.lit(""))), "_tokens": F.regexp_extract_all(F.lower(abstract), F.lit("[a-z0-9]+"), 0), **count})
    return made.withColumns({
        "_wanted": F.array_distinct(F.transform("_rows", lambda r: outcome_key(F.element_at(F.split(r[0], "/"), -1)))),
        "_keys": F.transform("_parts", lambda p: p["key"]),
        "_counted": counted,
        "_claimed": F.transform("_parts", lambda p: F.struct(p["key"].alias("key"), claims(p["body"]).alias("ns"))),
        "_levels": F.transform("_blocks", lambda b: F.struct(F.length(F.regexp_extract(b, "^(#+)", 1)).alias("level"), b.rlike(r"^[^\n]*\s*\z").alias("bare"))),
    })


def paper_rules(floors: dict[str, int] | None = None, ceilings: dict[str, int] | None = None, least_words: int = 5000, hedges: int = 4, depth: int = DEPTH, analysis: tuple[int, float] = (100, 0.15)) -> Rules:
    """Rules of judged(); analysis has the fewest words of a body and the share that Discussion and Cross-Domain Synthesis need.

    A pattern runs where the words are that it cannot do without.
    """
    floors, ceilings = FLOORS if floors is None else floors, CEILINGS if ceilings is None else ceilings
    c = lambda n: F.coalesce(F.col(slug(n)), F.lit(""))
    text, body, wanted, keys, levels = (F.col(x) for x in ("text", "body", "_wanted", "_keys", "_levels"))
    has_table = F.size("_rows") > 0
    has = lambda *terms: any_of(F.col("_low"), list(terms))
    differs = F.exists("_claimed", lambda p: F.exists("_counted", lambda t: (t["k"] == p["key"]) & F.exists(p["ns"], lambda n: n != t["n"])))
    defined = F.regexp_extract_all(text, F.lit(r"(?im)^(?:#{2,6}[ \t]+Table[ \t]+(\d+)\b|Table[ \t]+(\d+)[ \t]*[:.\u2014-])"), 0)
    numbers = F.transform(defined, lambda d: F.regexp_extract(d, r"(\d+)", 1))
    named = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?i)\bTable\s+(\d+)\b"), 1))
    absent = F.regexp_extract_all(c("Abstract"), F.lit(r"(?i)\b0\s+([a-z][a-z\s/-]+?)\s+sources?\b"), 1)
    terms = lambda a: F.filter(F.regexp_extract_all(F.lower(a), F.lit("[a-z]+"), 0), lambda t: (F.length(t) >= 6) & ~t.isin("source", "sources", "clinical", "direct", "adjacent"))
    hedged = reduce(add, [F.contains("_said", F.lit(h)).cast("int") for h in HEDGES])
    n_body, deep = F.col("_n_body"), F.col("_n_discussion") + F.col("_n_cross_domain_synthesis")
    rated = F.size(F.regexp_extract_all(text, F.lit(r"(?im)^#{2,4}[ \t]+(?:risk[ -]of[ -]bias|quality appraisal)[^\n]*\n(?:[^#|\n][^\n]*\n|\n)*\|[^\n]*\n\|[^\n]*\n\|[^\n]*"), 0)) > 0
    rules: Rules = {
        "thin": ("P1", F.col("_n_text") < least_words),
        "duplicate_references": ("P1", F.size(F.regexp_extract_all(text, F.lit(r"(?m)^## References"), 0)) > 1),
        "missing_references": ("P1", ~text.rlike(r"(?m)^##\s+References\b")),
        "empty_heading": ("P1", F.exists(F.transform(levels, lambda b, i: b["bare"] & (F.coalesce(F.get(levels, i + 1)["level"], F.lit(0)) <= b["level"])), lambda x: x)),
        "missing_outcome_section": ("P1", has_table & (F.size(F.array_except(wanted, keys)) > 0)),
        "unexpected_outcome_section": ("P1", has_table & (F.size(F.array_except(keys, wanted)) > 0)),
        "duplicate_outcome_section": ("P1", has_table & (F.size(F.array_distinct(keys)) < F.size(keys))),
        "count_mismatch": ("P1", differs),
        "orphan_table": ("P1", has("table") & (F.size(F.array_except(named, numbers)) > 0)),
        "duplicate_phrase": ("P1", _repeats(F.col("_tokens"))),
        "unresolved_template": ("P1", has("(s)", "(es)", "study/studies") & body.rlike(TEMPLATE_SLOT)),
        "abstract_contradiction": ("P1", F.contains(c("Abstract"), F.lit("0")) & F.exists(absent, lambda a: F.exists(terms(a), lambda t: F.rlike(F.col("_rest"), F.concat(F.lit(r"\b"), t, F.lit(r"\b")))))),
        "conclusion_scope": ("P1", c("Conclusion").rlike(r"(?i)\bseparates\s+endpoint[- ]specific\s+evidence\b")),
        "citation_artifact": ("P1", has("[", "<", "pmid", "doi") & body.rlike(CITATION_ARTIFACT)),
        "grammar_artifact": ("P1", has("to", "automatically", ".g.,") & body.rlike(GRAMMAR)),
        "classification_row": ("P1", has("|") & body.rlike(r"(?im)^\|\s*\*{0,2}(?:outcome class|directness|directional signal|evidence tier)\*{0,2}(?:\s|\||$)")),
        "pipeline_jargon": ("P1", has(*[j for j in JARGON if not any(k in j for k in JARGON if k != j)]) & F.lower(body).rlike(r"(?:^|[^\w-])(?:" + "|".join(JARGON) + r")(?:[^\w-]|$)")),
        "limitations_leak": ("P1", c("Limitations").rlike(LEAKED_SUMMARY)),
        "no_thesis": ("P1", (F.trim(c("Discussion")) != "") & ~c("Discussion").rlike(r"(?i)\*\*\s*thesis\s*:\s*\*\*")),
        "no_resolution": ("P1", (F.trim(c("Discussion")) != "") & ~c("Discussion").rlike(r"(?i)\*\*\s*resolution\s+criteria\s*:\s*\*\*")),
        "unresolved_statistic": ("P1", has("statistic", "estimate", "value", "interval") & text.rlike(UNRESOLVED_STATISTIC)),
        "human_verification": ("P1", has("verified", "reviewed", "verification") & text.rlike(HUMAN_CHECKED)),
        "polarity": ("P1", has("lifespan") & text.rlike(POLARITY)),
        "fabricated_methods": ("P1", _with_disclaimer(F.col("methods"), FABRICATED)),
        "low_hedging": ("P2", (F.trim(c("Discussion")) != "") & (hedged < hedges)),
        "shallow_discussion": ("P2", F.col("_n_discussion") < depth),
        "shallow_cross_domain": ("P2", F.col("_n_cross_domain_synthesis") < depth),
        "low_analysis": ("P2", (n_body < analysis[0]) | (deep / F.greatest(n_body, F.lit(1)) < analysis[1])),
        "unbacked_appraisal": ("P1", has("rob-2", "rob 2", "robins-i", "amstar") & body.rlike(FRAMEWORKS) & ~rated),
        "repair_artifact": ("P2", (has("(potentially)") | (has("evidence") & has("suggests") & has("that"))) & text.rlike(r"(?i)\(potentially\)|\bevidence\s+suggests\s+that\s+evidence\s+suggests\s+that")),
        "internal_tier_label": ("P2", has("1_", "2_") & body.rlike(TIER_LABEL)),
        "internal_handle": ("P1", has("_", "pmc") & body.rlike(HANDLE)),
    }
    for name, least in floors.items():
        rules[f"missing_{slug(name)}"] = ("P1", F.col(slug(name)).isNull())
        rules[f"short_{slug(name)}"] = ("P1", F.col(slug(name)).isNotNull() & (words(F.col(slug(name))) < least))
    for name, most in ceilings.items():
        rules[f"long_{slug(name)}"] = ("P1", words(F.col(slug(name))) > most)
    return rules


def paragraph_rules() -> Rules:
    """Rules of paragraphs()."""
    p = F.col("p")
    n = F.size(F.regexp_extract_all(F.lower(p), F.lit("[a-z0-9]+"), 0))
    prose = ~p.rlike(r"^[#|]")
    bare = F.regexp_replace(p, r"[\s)\]\"'*_`]+$", "")
    opens = lambda ch: F.size(F.split(F.regexp_replace(p, r"[\[(]\s*[+-]?\d+(?:\.\d+)?\s*,\s*[+-]?\d+(?:\.\d+)?\s*[\])]", ""), ch))
    return {
        "unsupported_novelty": ("P1", p.rlike(NOVELTY) & ~p.rlike(AUTHOR_YEAR)),
        "hedge_fragment": ("P1", (n <= 4) & p.rlike(HEDGE_FRAGMENT)),
        "citation_only_stub": ("P1", prose & p.rlike(CITATION_STUB)),
        "thin_analysis": ("P1", prose & n.between(5, 14) & p.rlike(ANALYTIC_STUB) & ~p.rlike(r"\d|;|:")),
        "truncated": ("P1", prose & (n >= 6) & bare.rlike(CUT_OFF)),
        "sentence_end_authoryear": ("P2", p.rlike(r"\b[A-Z][a-zA-Z]+\s+et\s+al\.\s+\d{4}\.(?:\s+[A-Z]|$)")),
        "unbalanced_parentheses": ("P1", prose & (opens(r"\(") != opens(r"\)"))),
    }


def sentence_rules() -> Rules:
    """Rules of sentences()."""
    s, both = F.col("s"), F.lower(F.concat_ws(" ", "s", "after"))
    specific = s.rlike(r"\b[A-Z][A-Za-z]+\s+\d{4}[a-z]?\b") | (s.rlike(r"\d") & s.rlike(MEASURE))
    return {
        "template_p1": ("P1", s.rlike(ALWAYS_P1)),
        "template_p2": ("P2", s.rlike(ALWAYS_P2)),
        "vague_limitation": ("P2", s.rlike(VAGUE) & ~specific),
        "unhedged_preclinical": ("P2", s.rlike(PRECLINICAL) & ~any_of(both, list(TRANSLATION)) & ~both.rlike("limitations|method")),
        "fragment_single_letter": ("P2", s.rlike(r"(?:^|[a-z]{2}\)\s+)[a-z]\s+[a-z]\w+")),
        "fragment_lowercase_start": ("P2", s.rlike(r"^(on|in|at|by|of|for|with|to)\s+(?:\d{4}|[A-Z])")),
    }


def overclaims(papers: DataFrame, declared: str) -> DataFrame:
    """(id, term): stronger methods than the declared review type that Abstract or Methods claim for themselves.

    papers has the columns of manuscripts() and `declared`.
    """
    scope = papers.select("id", declared, F.explode(F.split(F.lower(F.concat_ws("\n", "abstract", "methods")), r"(?<=[.!?])\s+")).alias("s"))
    table = F.create_map(*[x for k, v in STRONGER.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    each = scope.select("id", "s", F.explode(F.coalesce(F.try_element_at(table, F.col(declared)), F.array().cast("array<string>"))).alias("term")).where(F.contains("s", F.col("term")))
    denied = F.regexp_replace("s", F.concat(F.lit(r"\b(?:not|no|without)\s+(?:(?:a|an|the|systematic|scoping)\s+)*"), F.col("term")), F.lit(""))
    claimed = F.exists(F.array(*map(F.lit, SELF_CLAIMS)), lambda q: F.rlike(denied, F.concat(q, F.lit(r"(?s).{0,60}?"), F.col("term"))))
    return each.where(claimed).select("id", "term").distinct()


def cited(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep..., citation) of the author-year labels in a text, "et al." left out, each once."""
    labels = F.array_distinct(F.transform(F.regexp_extract_all(text_col, F.lit(AUTHOR_YEAR), 0), lambda c: F.regexp_replace(c, r"\s+et\s+al\.", "")))
    return rows.select(*keep, F.explode(labels).alias("citation"))


def misrouted(papers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, citation, section): citations of another outcome's sources under a Results heading, in sentences
    where the heading's own outcome is outnumbered. outcomes(citation, outcome)."""
    parts = papers.select("id", F.explode(_parts_of(F.coalesce("results", F.lit("")))).alias("p")).select("id", F.col("p.key").alias("section"), F.posexplode(F.split("p.body", r"(?<=[.!?])\s+")).alias("n", "s"))
    rows = cited(parts, "s", "id", "section", "n").join(outcomes.select("citation", outcome_key(F.col("outcome")).alias("outcome")).distinct(), "citation")
    by = ["id", "section", "n"]
    counts = rows.groupBy(*by, "outcome").agg(F.count("*").alias("k"))
    lead = counts.groupBy(*by).agg(F.max("k").alias("top"), F.coalesce(F.max(F.when(F.col("outcome") == F.col("section"), F.col("k"))), F.lit(0)).alias("own"))
    bad = lead.where(F.col("own") < F.col("top")).select(*by)
    return rows.join(bad, by, "left_semi").where(F.col("outcome") != F.col("section")).select("id", "citation", "section").distinct()


def unlabelled_animals(papers: DataFrame, animals: DataFrame) -> DataFrame:
    """(id, citation): animal sources, animals(citation), cited in a paragraph without a word that says so."""
    lanes = r"(?i)\b(?:" + "|".join(sorted(LANE_WORDS, key=len, reverse=True)) + r")s?\b"
    plain = paragraphs(papers).where(~F.col("p").startswith("|") & ~F.col("p").rlike(lanes))
    return cited(plain, "p", "id").distinct().join(animals.select("citation").distinct(), "citation", "left_semi").select("id", "citation")


# Words that state a direction in prose.
PROSE_DIRECTION = {
    "positive": r"(?i)\b(positive|benefit|beneficial|improv(?:e|ed|es|ing)|favorable)\b", "negative": r"(?i)\b(negative|adverse|worse|harm|detrimental|decrease|reduced)\b", "null": r"(?i)\b(null|no effect|no additional|no significant|non-supportive|unchanged)\b",
}
DIRECTION_WORDS = {"positive": ("positive", "benefit", "beneficial", "supportive", "increase"), "negative": ("negative", "adverse", "harm", "decrease"), "null": ("null", "none", "no effect", "no change", "no extracted directional signal")}


def coded_direction(value: Column) -> Column:
    low = F.replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit("_"), F.lit(" "))
    out = F.lit("mixed")
    for k, terms in DIRECTION_WORDS.items():
        out = F.when(low.isin(*terms), k).otherwise(out)
    return out


def prose_mismatches(papers: DataFrame, receipts: DataFrame) -> DataFrame:
    """(id, citation, coded, stated): the first sentence on a source that states another direction than receipts(citation, direction)."""
    said = F.lit(None).cast("string")
    for k, p in reversed(PROSE_DIRECTION.items()):
        said = F.when(F.col("s").rlike(p), k).otherwise(said)
    rows = cited(sentences(papers).withColumn("stated", said).where("stated is not null"), "s", "id", "n", "stated").join(receipts.select("citation", coded_direction(F.col("direction")).alias("coded")), "citation").where("stated <> coded")
    return rows.groupBy("id", "citation", "coded").agg(F.min_by("stated", "n").alias("stated"))


def overgrouped(papers: DataFrame, receipts: DataFrame) -> DataFrame:
    """(id, n, directions): sentences of the abstract that cite sources of several directions together."""
    rows = cited(sentences(papers, "abstract"), "s", "id", "n").join(receipts.select("citation", coded_direction(F.col("direction")).alias("coded")), "citation")
    return rows.groupBy("id", "n").agg(F.array_sort(F.collect_set("coded")).alias("directions")).where(F.size("directions") > 1)


REVIEW_TITLE = r"(?i)\b(systematic review|meta-?analys(?:is|es)?|umbrella review|scoping review|pooled analys(?:is|es)?|narrative review|review of)\b"
PRIMARY_TITLE = r"(?i)\b(randomi[sz]ed controlled trial|RCT|controlled clinical (?:study|trial)|double-blind|placebo-controlled|crossover trial|cohort study)\b"
BAD_LABEL = r"^DOI_[A-Za-z0-9_]+|^HIT_[A-Za-z0-9_]+|^PMID\d+_[A-Za-z0-9_]+|PMC\d{6,9}_[a-zA-Z_]{10,}|[A-Z][a-zA-Z]+_\d{4}_[A-Za-z_]+_|^[A-Z][a-zA-Z]+_\d{4}$|^PMC\d{6,9}$|(?i)^CORRECT(?:ING|ION)?\s+\d{4}[a-z]?$"


def receipt_rules(current_year: int) -> Rules:
    """Rules of receipts(receipt_id, title, directness, year, label)."""
    title, d = F.coalesce("title", F.lit("")), F.lower(F.coalesce("directness", F.lit("")))
    review = title.rlike(REVIEW_TITLE)
    return {
        "missing_receipt_id": ("P2", F.trim(F.coalesce("receipt_id", F.lit(""))) == ""),
        "directness_coding": ("P2", ((d == "direct") & review) | ((d == "review") & title.rlike(PRIMARY_TITLE) & ~review)),
        "future_citation": ("P1", F.col("year") > current_year),
        "blocked_label": ("P1", F.coalesce("label", F.lit("")).rlike(BAD_LABEL)),
    }


def publication_year(value: Column, current_year: int, least: int = 1990) -> Column:
    """A year in the plausible window, else null."""
    y = F.when(F.trim(value).rlike("^[0-9]{4}$"), F.trim(value).cast("int"))
    return F.when(y.between(least, current_year), y)


def year_of_id(receipt_id: Column, current_year: int) -> Column:
    """The last plausible year in an id."""
    years = F.filter(F.transform(F.regexp_extract_all(receipt_id, F.lit(r"(?:^|[_\s-])((?:19|20)\d{2})(?=[_\s-]|$)"), 1), lambda y: publication_year(y, current_year)), lambda y: y.isNotNull())
    return F.try_element_at(years, F.lit(-1))


def body_citation(author: Column, year: Column, current_year: int) -> Column:
    """The first author's surname with the year, undated where it is not plausible; null without a surname.

    Accented Latin letters lose their accents.
    """
    folded = F.translate(author, "àáâãäåèéêëìíîïòóôõöùúûüçñýÿÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÇÑÝ", "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY")
    name = F.regexp_replace(F.element_at(F.split(F.trim(folded), r"\s+"), -1), "[^A-Za-z-]", "")
    named = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 100))
    return F.when(name != "", F.concat_ws(" ", named, F.coalesce(publication_year(year, current_year).cast("string"), F.lit("n.d."))))
