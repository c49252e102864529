"""Numbers in prose against numbers in sources: pools, variants, roles and significance.

Claims are rows (paper, citation, confidence, claim_type, role, value text); prose is
rows of sentences. Numbers are joined by their canonical variants, so that 5, 5.0 and
5 mg meet; a number costs the rows that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import canonical_number
from weft.operators.matching import once

# Claim types that count as objective, roles, and what they go with.
OBJECTIVE = ("unit_value", "sample_size", "year", "sample_count")
PROSE_ROLES = {
    "baseline": r"\b(?:baseline|starting|pre[\-\s]?treatment|initial|enrolment|enrollment)\b",
    "population": r"\b(?:participants?|patients?|subjects?|sample\s+size|enrolled|recruited|aged?)\b",
    "change_score": r"\b(?:change|delta|difference|increase|decrease|improvement|reduction|decline|shift)\s+(?:of|by|in|from\s+baseline)?\b",
    "threshold": r"\b(?:threshold|cut[\-\s]?off|cutoff|below|above|less\s+than|greater\s+than|exceeds?|falls?\s+(?:at\s+or\s+)?(?:below|above))\b",
    "dose": r"\b(?:dose|dosing|mg|mcg|µg|g/day|mg/day|once\s+daily|weekly|administered|treated\s+with)\b",
    "effect": r"\b(?:reported|observed|p\s*[<=>]|hr\s*=|or\s*=|rr\s*=|effect\s+size|outcome|primary\s+endpoint)\b",
}
TIME_UNIT = r"^\s*[-–—]?\s*(?:month|year|week|day|hour|wk|yr|mo)s?\b"
AGE = r"\b(?:aged?|years?\s+of\s+age|years?[-\s]old)\b"
COMPATIBLE = {
    "baseline": ("baseline", "population", "outcome"), "population": ("population", "baseline", "outcome"), "change_score": ("change_score", "effect", "outcome"), "threshold": ("threshold", "canonical"), "duration": ("duration",),
    "dose": ("dose", "unit_value", "outcome", "effect"), "effect": ("effect", "change_score", "outcome"), "outcome": ("outcome", "effect", "population", "baseline", "change_score", "dose", "unit_value", "canonical"),
}
BEFORE, AFTER = 60, 30
NUMBER = r"(?<![A-Za-z0-9.])[0-9]+(?:\.[0-9]+)?"
CITATION = r"\b[A-Z][A-Za-z]+ (?:19|20)[0-9]{2}[a-z]?\b"


def number_key(c: Column) -> Column:
    """A number as text without unit, separators or idle zeros; null if it does not start with one."""
    x = F.regexp_extract(canonical_number(F.lower(F.trim(c))), r"^([0-9]+(?:\.[0-9]+)?)", 1)
    short = F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
    return F.when(x != "", F.regexp_replace(short, r"^0+(?=[0-9])", ""))


def variants(c: Column) -> Column:
    """Renderings of a number that count as equal: as given, bare, whole and with a decimal."""
    raw = F.when(F.trim(c).startswith("."), F.concat(F.lit("0"), F.trim(c))).otherwise(F.trim(c))
    bare, key = F.regexp_extract(raw, r"^([0-9]+\.?[0-9]*)", 1), number_key(c)
    decimal = F.when(F.contains(key, F.lit(".")), key).otherwise(F.concat(key, F.lit(".0")))
    return F.array_sort(F.array_distinct(F.filter(F.array(raw, F.nullif(bare, F.lit("")), key, decimal), lambda x: x.isNotNull())))


def pool(claims: DataFrame, strict: bool) -> DataFrame:
    """(number) that prose (strict) or tables may state, of claims(confidence, claim_type, value).

    Confident claims count; partial ones everywhere in tables, in prose only of objective types.
    """
    confidence = F.lower(F.coalesce("confidence", F.lit("")))
    partial = (confidence == "partial") & (F.col("claim_type").isin(*OBJECTIVE) if strict else F.lit(True))
    # A value that claims share is read once: the count holds the reading above the aggregate, below which Spark would move the filter.
    values = claims.where((confidence == "high") | partial).groupBy("value").agg(F.count("*").alias("times"))
    return values.select(F.when(F.col("times") > 0, number_key(F.col("value"))).alias("number")).where("number is not null").distinct()


def traced(prose: DataFrame, strict: DataFrame, loose: DataFrame) -> DataFrame:
    """(id, numbers, traced, coverage, passed) of prose(id, in_table, number): tables are held against the loose pool."""
    known = strict.select("number", F.lit(False).alias("in_table")).union(loose.select("number", F.lit(True))).withColumn("hit", F.lit(1))
    rows = prose.join(known, ["number", "in_table"], "left").groupBy("id").agg(F.count("*").alias("numbers"), F.count("hit").alias("traced"))
    return rows.withColumn("coverage", F.round(F.col("traced") / F.col("numbers"), 6)).withColumn("passed", F.col("traced") == F.col("numbers"))


def prose_role(before: Column, number: Column, after: Column) -> Column:
    """What a sentence says that a number is, from BEFORE characters before it and AFTER after it."""
    window = F.lower(F.concat(F.substring(before, -BEFORE, BEFORE), number, F.substring(after, 1, AFTER)))
    out = F.lit("outcome")
    for k, p in reversed(PROSE_ROLES.items()):
        out = F.when(window.rlike(p), k).otherwise(out)
    return F.when(F.lower(F.substring(after, 1, 14)).rlike(TIME_UNIT) & ~window.rlike(AGE), "duration").otherwise(out)


def roles_match(role: Column, sources: Column) -> Column:
    """Whether a prose role goes with any of a source's roles; none known, or a canonical one, passes."""
    fits = F.lit(False)
    for k, allowed in COMPATIBLE.items():
        fits = F.when(role == k, F.arrays_overlap(sources, F.array(*map(F.lit, allowed)))).otherwise(fits)
    return (F.size(sources) < 1) | F.array_contains(sources, "canonical") | fits


def role_index(claims: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """(citation, number, roles): every role that a number has in a cited source, of
    claims(citation, role, value) and background(citation, value), whose role is canonical."""
    rows = claims.select("citation", F.lower(F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("outcome"))).alias("role"), number_key(F.col("value")).alias("number"))
    if background is not None:
        rows = rows.union(background.select("citation", F.lit("canonical"), number_key(F.col("value"))))
    return rows.where("number is not null").groupBy("citation", "number").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def stated(sentences: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, number, role, citation): each number of a sentence, but for years, with each citation of it."""
    text = F.col(text_col)
    cited = F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), 0))
    # Citations hold years, which are no statements.
    plain = F.regexp_replace(text, CITATION, "@")
    parts = F.split(plain, NUMBER)
    found = F.regexp_extract_all(plain, F.lit(NUMBER), 0)
    # What is before a number is all parts and numbers up to it.
    pieces = F.transform(found, lambda n, i: F.struct(
        i.alias("at"), n.alias("raw"),
        prose_role(F.concat(F.array_join(F.flatten(F.transform(F.slice(found, 1, i), lambda m, j: F.array(F.get(parts, j), m))), ""), F.get(parts, i)), n, F.array_join(F.flatten(F.transform(F.slice(F.concat(found, F.array(F.lit(""))), i + 2, 2), lambda m, j: F.array(F.get(parts, i + 1 + j), m))), "")).alias("role"),
    ))
    rows = sentences.where(F.size(cited) > 0).select(F.col(id_col).alias("id"), F.explode(pieces).alias("p"), cited.alias("c"))
    years = F.col("p.raw").rlike("^(19[0-9]{2}|20[0-9]{2}|2100)$")
    return rows.where(~years).select("id", "p.at", number_key(F.col("p.raw")).alias("number"), "p.role", F.explode("c").alias("citation"))


def role_drift(sentences: DataFrame, id_col: str, text_col: str, index: DataFrame) -> DataFrame:
    """(id, at, number, role, issue): numbers that no source cited beside them has (value_drift), or none
    in a role that goes with the prose's (role_drift). Sentences with an unknown citation are left alone.

    A sentence that rows share is read and judged once.
    """
    rows = sentences.select(F.col(id_col).alias("id"), F.col(text_col).alias("_said"))
    return rows.join(_drifts(once(rows.select("_said")), index), "_said").select("id", "at", "number", "role", "issue").distinct()


def _drifts(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(_said, at, number, role, issue) of distinct texts(_said)."""
    said = stated(texts, "_said", "_said")
    known = index.select("citation").distinct().withColumn("registered", F.lit(True))
    rows = said.join(known, "citation", "left").join(index, ["citation", "number"], "left")
    each = rows.groupBy("id", "at", "number", "role").agg(
        F.bool_or(F.col("registered").isNull()).alias("strange"), F.bool_or(F.col("roles").isNotNull()).alias("there"), F.bool_or(F.when(F.col("roles").isNotNull(), roles_match(F.col("role"), F.col("roles")))).alias("fits")
    )
    issue = F.when(~F.col("there"), "value_drift").when(~F.col("fits"), "role_drift")
    return each.where(~F.col("strange")).select(F.col("id").alias("_said"), "at", "number", "role", issue.alias("issue")).where("issue is not null")


# Words of significance and hedging.
ADJUSTED = r"(?i)\b(?:bonferroni|holm|false discovery|fdr|multiplicity|multiple[- ]testing|prespecified alpha|significance threshold|adjusted (?:alpha|p[- ]?value|threshold|significance))\b"
NOT_SIGNIFICANT = r"(?i)\b(?:non[- ]?significant(?:ly)?|(?:not|no)\s+(?:statistically\s+)?significant(?:ly)?|did\s+not\s+reach\s+significance)\b"
SIGNIFICANT = r"(?i)\b(?:nominally\s+)?(?:statistically\s+)?significant\b"
WEAK = r"(?i)\b(?:marginal(?:ly)?|borderline|non\s*-?\s*significan\w*|not(?:\s+\w+){0,2}\s+significan\w*|trend(?:ing|ed|s)?\s+to(?:ward|wards)?|a\s+trend)\b"
P_TEXT = r"(?i)\bp\s*(<=|>=|[=<>≤≥])\s*(\d*\.?\d+(?:e[-+]?\d+)?)"
HEDGES = ("may", "might", "suggests", "consistent with", "appears", "context-dependent", "uncertain", "warrants", "remains to be", "preliminary", "interpretive", "qualified", "limited", "cautious")


def nominal_significance(p: Column) -> Column:
    """Whether a p-value text is below 0.05; null if there is none or its bound leaves it open."""
    op, v = F.regexp_extract(p, P_TEXT, 1), F.nullif(F.regexp_extract(p, P_TEXT, 2), F.lit("")).cast("double")
    return F.when((v < 0) | (v > 1), None).when(op == "=", v < 0.05).when(((op == "<") & (v <= 0.05)) | (op.isin("<=", "≤") & (v < 0.05)), True).when(op.isin(">", ">=", "≥") & (v >= 0.05), False)


def wording_mismatch(sentence: Column) -> Column:
    """Whether a clause's words on significance contradict its p-values, unless it names an adjusted threshold."""

    def clause(c: Column) -> Column:
        ps = F.regexp_extract_all(c, F.lit(P_TEXT), 0)
        values = F.transform(ps, nominal_significance)
        yes, no = F.forall(values, lambda v: F.coalesce(v, F.lit(False))), F.forall(values, lambda v: F.coalesce(~v, F.lit(False)))
        low = F.exists(ps, lambda p: F.coalesce(nominal_significance(p), F.lit(False)) & ((F.regexp_extract(p, P_TEXT, 2).cast("double") < 0.01) | ((F.regexp_extract(p, P_TEXT, 1) == "<") & (F.regexp_extract(p, P_TEXT, 2).cast("double") <= 0.01))))
        plain = F.regexp_replace(c, NOT_SIGNIFICANT, "")
        return (F.size(ps) > 0) & ~c.rlike(ADJUSTED) & ((c.rlike(WEAK) & low) | (c.rlike(NOT_SIGNIFICANT) & yes) | (plain.rlike(SIGNIFICANT) & no))

    return F.exists(F.split(sentence, r"(?i)\n|\||;|\b(?:while|whereas|but)\b"), clause)


def hedge_count(section: Column) -> Column:
    """How many different hedges a section holds."""
    low = F.lower(F.coalesce(section, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, HEDGES)), lambda h: F.contains(low, h)))


def context_window(text: Column, start: Column, end: Column, radius: int = 60) -> Column:
    """The text around a span, white space collapsed; offsets from 0."""
    a = F.greatest(start - radius, F.lit(0))
    return F.trim(F.regexp_replace(F.substring(text, a + 1, F.least(end + radius, F.length(text)) - a), r"\s+", " "))


# Endpoints, units and types of rows of the evidence index.
UNBOUND = ("unknown", "background", "", "n/a", "none", "?")
TEMPORAL_UNITS = ("years", "year", "months", "month", "weeks", "week", "days", "day", "hours")
TEMPORAL_ENDPOINTS = ("duration", "follow-up", "follow up", "follow_up", "study duration", "trial duration", "median follow-up", "age", "treatment duration", "intervention duration", "exposure duration")
DOSE_UNITS, DOSE_ENDPOINTS = ("mg", "g", "mcg", "µg", "μg", "ng"), ("dose", "dosing", "dosage", "drug dose", "treatment dose", "intervention dose")
RATIO_TYPES = ("hazard_ratio", "odds_ratio", "risk_ratio")
TYPE_POINTS = {"hazard_ratio": 5, "odds_ratio": 5, "risk_ratio": 5, "sample_size": 4, "p_value": 3, "confidence_interval": 3, "percentage": 1}


def admissible(confidence: Column) -> Column:
    return F.lower(F.coalesce(confidence, F.lit(""))).isin("high", "partial")


def claim_quality(claim_type: Column, endpoint: Column, arm: Column) -> Column:
    """Points of a claim: its type, two for a bound endpoint, one for an arm."""
    points = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TYPE_POINTS.items() for x in p]), claim_type), F.lit(0))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return points + F.when(given(endpoint), 2).otherwise(0) + F.when(given(arm), 1).otherwise(0)


def dense_list(raw: Column, endpoint: Column, sentence: Column) -> Column:
    """Whether a p-value of a sentence with several stands without a word of its endpoint within 40 characters."""
    low, r = F.lower(sentence), F.lower(raw)
    at = F.position(r, low)
    words = F.filter(F.regexp_extract_all(F.lower(endpoint), F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) >= 3) & ~t.isin("and", "the", "with"))
    a = F.greatest(at - 1 - 40, F.lit(0))
    window = F.substring(low, a + 1, at - 1 + F.length(r) + 40 - a)
    loose = (at == 0) | (F.size(words) == 0) | ~F.exists(words, lambda t: F.contains(window, t))
    return (F.size(F.regexp_extract_all(low, F.lit(r"\bp\s*[<=>]\s*0?\.\d+"), 0)) >= 2) & loose


def meaningful(c: dict[str, Column]) -> Column:
    """Whether a claim can stand as a row of the evidence index.

    c has endpoint, role, claim_type, confidence, direction, units, raw and sentence. Unbound endpoints, context
    roles, units that do not fit the endpoint, and numbers that are no results are left out.
    """
    low = {k: F.lower(F.trim(F.coalesce(v, F.lit("")))) for k, v in c.items()}
    kind, unit, endpoint, s = low["claim_type"], low["units"], low["endpoint"], F.coalesce(c["sentence"], F.lit(""))
    balanced = s.rlike(r"(?i)\bbaseline\b") & s.rlike(r"(?i)\b(?:similar|comparable|balanced|(?:not|no)\b.{0,35}\bdiffer\w*)\b") & ~s.rlike(r"(?i)\b(?:adjust\w*|chang\w*|reduc\w*|decreas\w*|increas\w*|improv\w*|follow[ -]?up|after|post\w*)\b")
    about_interval = (kind == "percentage") & (((low["raw"] == "95%") & F.contains(low["sentence"], F.lit("95% ci"))) | F.contains(low["sentence"], F.lit("heterogeneity")) | low["sentence"].rlike(r"\bi\s*(?:2|²)(?:\s|$)"))
    bad = (
        endpoint.isin(*UNBOUND) | low["role"].isin("background", "protocol", "population_descriptor") | ((kind == "mean_sd") & ~low["role"].isin("effect", "outcome")) | ((kind == "p_value") & dense_list(c["raw"], c["endpoint"], s))
        | ((low["role"] == "dose") & ~endpoint.isin(*DOSE_ENDPOINTS)) | ((kind == "sample_size") & (low["role"] != "population"))
        | (kind.isin(*RATIO_TYPES) & (((low["confidence"] != "high") & (low["direction"] == "")) | endpoint.isin("body mass index", "bmi")))
        | ((kind == "unit_value") & unit.isin(*TEMPORAL_UNITS) & ~endpoint.isin(*TEMPORAL_ENDPOINTS)) | ((kind == "unit_value") & unit.isin(*DOSE_UNITS) & ~endpoint.isin(*DOSE_ENDPOINTS)) | balanced | about_interval
    )
    return ~bad


# Classes of units and endpoints, and which go together.
ENDPOINT_WORDS = {
    "event": ("mortality", "survival", "death", "incident"), "pressure": ("blood pressure", "systolic", "diastolic"), "bmi": ("body mass index", "bmi"), "biomarker": ("glucose", "hba1c", "cholesterol", "ldl", "hdl", "triglyceride", "insulin", "crp", "biomarker", "inflammation"),
    "renal": ("egfr", "kidney", "renal", "glomerular"), "speed": ("walk speed", "gait speed", "walking speed"), "mass": ("body weight", "lean mass", "fat mass", "muscle mass"), "strength": ("strength", "grip", "force"), "scale": ("frailty", "score", "index", "cognition"),
}


def endpoint_class(endpoint: Column) -> Column:
    from weft.functions.text import bucket_of

    return bucket_of(F.lower(F.coalesce(endpoint, F.lit(""))), {k: list(v) for k, v in ENDPOINT_WORDS.items()}, "")


def unit_class(unit: Column, value: Column) -> Column:
    """The first class that a unit, or a value with it, belongs to."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    hay = F.lower(F.concat_ws(" ", u, value))
    has = lambda *terms: hay.rlike("|".join(terms))
    return (
        F.when(u.isin("", "-", "—", "–", "none", "n/a", "na"), "").when(has("sample size", r"\bn\s*="), "count").when(has("p value", r"\bp\s*[<=>]"), "p_value").when(has("95%ci", "confidence interval"), "ci").when(has("hazard ratio", "odds ratio", "risk ratio"), "ratio")
        .when(has("%", "percentage"), "percentage").when(has("kg/m2", "kg/m²"), "bmi_unit").when(has("mg/dl", "mmol/l", "ng/ml"), "concentration").when(has(r"\bml\s*/\s*min\b"), "renal_rate").when(u.isin("ml", "l"), "volume").when(u.isin(*DOSE_UNITS), "dose")
        .when(has("mmhg"), "pressure").when(has("m/s"), "speed").when(has(r"\b(years?|months?|weeks?|days?|hours?)\b"), "duration").when(has(r"\b(?:cm|mm)\b"), "length").when(has(r"\bkg\b"), "mass").when(has("mean sd"), "summary_stat").otherwise("")
    )


_COMMON_UNITS = ("count", "p_value", "ci", "ratio", "percentage", "summary_stat")
ALLOWED_UNITS = {
    "event": _COMMON_UNITS, "pressure": (*_COMMON_UNITS, "pressure"), "bmi": (*_COMMON_UNITS, "bmi_unit"), "biomarker": (*_COMMON_UNITS, "concentration"), "renal": (*_COMMON_UNITS, "renal_rate"), "speed": (*_COMMON_UNITS, "speed"),
    "mass": (*_COMMON_UNITS, "mass"), "strength": (*_COMMON_UNITS, "mass"), "scale": _COMMON_UNITS,
}
MALFORMED_NUMBER = r"(?i)(?:^|[^\d,])0{2,}(?:\.\d+)?\s*(?:mg/day|mg|g|mcg|µg|μg|ng|kg|m/s|mmHg)\b"


def row_issues(endpoint: Column, value: Column, unit: Column, study: Column) -> Column:
    """What keeps a row out of the evidence index: a blank endpoint, an empty row, a malformed study id or number, or a unit that its endpoint cannot have."""
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    e, v, u, s = text(endpoint), text(value), text(unit), F.trim(F.coalesce(study, F.lit("")))
    dash = lambda c: c.isin("", "-", "—", "–", "none", "n/a", "na")
    ec, uc = endpoint_class(e), unit_class(u, v)
    fits = F.lit(False)
    for k, allowed in ALLOWED_UNITS.items():
        fits = F.when(ec == k, uc.isin(*allowed)).otherwise(fits)
    checks = {
        "endpoint": e.isin("", "unknown", "background", "effect", "n/a", "none", "?"), "empty": dash(v) & dash(u), "study": F.when(F.contains(s, F.lit("_")), s.rlike(r"(?:_\w{1,5}|_+)$")).otherwise(s.rlike(r"\b(?:19|20)\d{2}[a-z]{2,}$")),
        "number": F.concat_ws(" ", v, u).rlike(MALFORMED_NUMBER), "unit": (ec != "") & (uc != "") & ~fits,
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
