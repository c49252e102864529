"""Orderings, short lists and cells of tables: what a writer or a reader sees first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.text import bucket_of, missing
from weft.operators.numerics import nominal_significance

# Orders of tiers, roles and claim types.
WRITER_TIERS = {"A1": 0, "A2": 1, "B": 2, "C": 3}
WRITER_ROLES = {"published_results": 0, "review": 1, "registered_pending": 2, "published_protocol": 3, "mechanistic": 4, "off_domain": 5}
PUBLIC_TIERS = {"A1": 5, "A2": 4, "B1": 3, "B2": 2, "C1": 1, "C2": 1}
CLAIM_ORDER = ("p_value", "percentage", "ratio", "ci", "unit_value", "mean_sd", "sample_size")
POOL_ORDER = {"core": 0, "adjacent": 1, "background": 2}
BUDGET = 16
DIRECTIONS = ("positive", "negative", "null", "mixed", "unclear")


def _at(values: dict[str, int], key: Column, default: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), key), F.lit(default))


def ranked(rows: DataFrame, by: list[str], order: list[Column], n: int, into: str = "place") -> DataFrame:
    """The first n rows of each group, numbered from 1."""
    return rows.withColumn(into, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(into) <= n)


def for_writer(items: DataFrame, by: str, n: int = BUDGET) -> DataFrame:
    """The first n of items(by, ref, direct, tier, role, year) of each topic: direct, then by tier, role and recency."""
    return ranked(items, [by], [(~F.col("direct")).cast("int"), _at(WRITER_TIERS, F.col("tier"), 9), _at(WRITER_ROLES, F.col("role"), 9), -F.coalesce("year", F.lit(0)), F.col("ref")], n)


def for_readers(receipts: DataFrame, by: str, n: int) -> DataFrame:
    """The first n of receipts(by, receipt, tier, directness, n_claims): by tier, direct ones first, then by claims."""
    return ranked(receipts, [by], [-_at(PUBLIC_TIERS, F.upper(F.coalesce("tier", F.lit(""))), 0), (F.coalesce("directness", F.lit("")) != "direct").cast("int"), -F.coalesce("n_claims", F.lit(0)), F.col("receipt")], n)


def top_claims(claims: DataFrame, by: str, order: str, n: int = 5, malformed: Column | None = None) -> DataFrame:
    """n of claims(by, order, claim_type) of each paper: first one of each type in order of types, then the rest as they come."""
    rows = claims if malformed is None else claims.where(~malformed)
    kind = F.array_position(F.array(*map(F.lit, CLAIM_ORDER)), F.col("claim_type"))
    first = F.row_number().over(W.partitionBy(by, "claim_type").orderBy(order)) == 1
    rows = rows.withColumn("_lead", F.when((kind > 0) & first, kind).otherwise(F.lit(len(CLAIM_ORDER) + 1)))
    return ranked(rows, [by], [F.col("_lead"), F.col(order)], n).drop("_lead")


def for_extraction(entries: DataFrame, n: int | None = None) -> DataFrame:
    """entries(primary_trial, pool, score, n_sources, year, title) in the order that they are fetched in."""
    order = [(~F.col("primary_trial")).cast("int"), _at(POOL_ORDER, F.col("pool"), 3), -F.col("score"), -F.coalesce("n_sources", F.lit(0)), -F.coalesce("year", F.lit(0)), F.lower(F.coalesce("title", F.lit("")))]
    out = entries.orderBy(*order)
    return out if n is None else out.limit(n)


def net_direction(rows: DataFrame, by: str, direction: str) -> DataFrame:
    """(by, net): the one direction there is, mixed if any is or both signs are, else the sign, else unclear."""
    d = F.coalesce(missing(F.col(direction)), F.lit("unclear"))
    g = rows.groupBy(by).agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.bool_or(d == "mixed").alias("m"), F.bool_or(d == "positive").alias("p"), F.bool_or(d == "negative").alias("n"))
    return g.select(by, F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("m") | (F.col("p") & F.col("n")), "mixed").when(F.col("p"), "positive").when(F.col("n"), "negative").otherwise("unclear").alias("net"))


def direction_cells(rows: DataFrame, by: str, direction: str) -> DataFrame:
    """(by, cell): counts of all directions as a table's cell."""
    d = F.lower(F.coalesce(missing(F.col(direction)), F.lit("unclear")))
    g = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(d == k).alias(k) for k in DIRECTIONS])
    parts = [x for k in DIRECTIONS for x in (F.lit(f"{k}="), F.col(k).cast("string"), F.lit(", "))][:-1]
    return g.select(by, F.concat(*parts, F.lit(" (n="), F.col("n").cast("string"), F.lit(")")).alias("cell"))


def significant_count(p_values: Column) -> Column:
    """How many of an array of p-value texts are significant."""
    return F.size(F.filter(F.coalesce(p_values, F.array().cast("array<string>")), lambda p: F.coalesce(nominal_significance(p), F.lit(False))))


def signal_cells(rows: DataFrame, by: str, direction: str, p_values: str) -> DataFrame:
    """(by, cell): the leading direction of a group, or what its statistics say where it leads nowhere; ties go to the later name."""
    d = F.lower(F.coalesce(missing(F.col(direction)), F.lit("unclear")))
    flagged = rows.select(by, d.alias("d"), (significant_count(F.col(p_values)) > 0).alias("sig"), (F.size(F.coalesce(F.col(p_values), F.array().cast("array<string>"))) > 0).alias("stat"))
    per = flagged.groupBy(by, "d").agg(F.count("*").alias("k"), F.count_if("sig").alias("sig"), F.count_if("stat").alias("stat"))
    g = per.groupBy(by).agg(F.sum("k").alias("n"), F.max(F.struct("k", "d")).alias("top"), F.sum("sig").alias("sig"), F.sum("stat").alias("stat"))
    of = lambda k: F.concat(k.cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" sources"))
    top, coded = F.col("top.d"), F.concat(F.lit("; receipt-level direction coded "), F.col("top.d"))
    cell = (
        F.when(top.isin("positive", "negative", "mixed"), F.concat(top, F.lit(" signal in "), of(F.col("top.k"))))
        .when(F.col("sig") > 0, F.concat(F.lit("significant source statistic in "), of(F.col("sig")), coded))
        .when(F.col("stat") > 0, F.concat(F.lit("reported statistic in "), of(F.col("stat")), coded))
        .when(top == "null", F.concat(F.lit("no extracted directional signal in "), of(F.col("top.k"))))
        .otherwise(F.concat(top, F.lit(" signal in "), of(F.col("top.k"))))
    )
    return g.select(by, cell.alias("cell"))


def fill_rate(rows: DataFrame, by: str, fields: list[str], blanks: tuple[str, ...] = ("", "-", "—", "unknown", "n/a", "none")) -> DataFrame:
    """(by, rate): the share of cells that say something, to six places."""
    filled = [(~F.coalesce(F.lower(F.trim(F.col(f).cast("string"))), F.lit("")).isin(*blanks)).cast("int") for f in fields]
    return rows.groupBy(by).agg(F.round(F.sum(sum(filled[1:], filled[0])) / (F.count("*") * len(fields)), 6).alias("rate"))


def context_counts(rows: DataFrame, text: Column, contexts: dict[str, list[str]]) -> DataFrame:
    """(context, n): rows by the first context whose words their text holds; others are left out."""
    return rows.select(bucket_of(F.lower(F.coalesce(text, F.lit(""))), contexts, "").alias("context")).where("context <> ''").groupBy("context").agg(F.count("*").alias("n"))


def reconciled_funnel(counts: DataFrame, receipts: DataFrame) -> DataFrame:
    """(stage, n): a funnel's counts(stage, n) with the strict admissions renamed, and what was admitted of receipts(tier, directness)."""
    old = counts.select(F.when(F.col("stage") == "accepted_high_confidence", "original_strict_high_confidence").otherwise(F.col("stage")).alias("stage"), "n")
    row = receipts.agg(F.count("*").alias("admitted_receipts"), F.count_if(F.col("directness") == "direct").alias("direct_receipts"), F.count_if(F.col("tier").isin("A1", "A2", "B1")).alias("primary_tier_receipts"))
    return old.unionByName(row.unpivot([], row.columns, "stage", "n"))


def topic_funnel(papers: DataFrame, runs: DataFrame, topic: str) -> DataFrame:
    """(topic, papers, with_claims, claims, with_design, last_run): papers(topic, n_claims, design) and the last of runs(topic, run)."""
    g = papers.groupBy(topic).agg(F.count("*").alias("papers"), F.count_if(F.col("n_claims") > 0).alias("with_claims"), F.sum("n_claims").alias("claims"), F.count_if(missing(F.col("design")).isNotNull()).alias("with_design"))
    return g.join(runs.groupBy(topic).agg(F.max("run").alias("last_run")), topic, "left")


def accepted_papers(papers: DataFrame, receipts: DataFrame) -> DataFrame:
    """(paper): papers(paper, doi, pmid) with the DOI or PMID of a receipt(doi, pmid)."""
    ids = lambda d, *keep: d.select(*keep, F.explode(F.filter(F.array(F.concat(F.lit("d:"), missing(F.lower(F.trim("doi")))), F.concat(F.lit("p:"), missing(F.trim("pmid")))), lambda k: k.isNotNull())).alias("k"))
    return ids(papers, "paper").join(ids(receipts).distinct(), "k", "left_semi").select("paper").distinct()


def paper_id(doi: Column, pmid: Column, nct: Column, ordinal: Column) -> Column:
    """The first id that a hit has, else its number."""
    return F.coalesce(missing(doi), missing(pmid), missing(nct), F.concat(F.lit("hit_"), ordinal.cast("string")))


def distinct_aliases(*lists: Column) -> Column:
    """Aliases of several arrays in order, each once in any case, as first written."""
    all_ = F.filter(F.transform(F.concat(*lists), lambda a: F.trim(a)), lambda a: a != "")
    low = F.transform(all_, lambda a: F.lower(a))
    return F.filter(F.transform(all_, lambda a, i: F.when(F.array_position(low, F.lower(a)) == i + 1, a)), lambda a: a.isNotNull())


def extraction_pools(background: Column) -> Column:
    """Pools that go on to extraction."""
    return F.when(background, F.array(F.lit("adjacent"), F.lit("background"), F.lit("core"))).otherwise(F.array(F.lit("adjacent"), F.lit("core")))


# Caps and switches of retrieval modes.
MODES = {"smoke": (100, 25, False, False), "calibrated": (200_000, 100, True, True), "exhaustive": (200_000, 100, False, True), "snowball": (200_000, 100, True, False)}


def retrieval_params(mode: Column, cap: Column, page: Column) -> Column:
    """struct(cap, page, yield_stop, waves) of a mode, with overrides; null for an unknown mode."""
    out = F.lit(None).cast("struct<cap:int,page:int,yield_stop:boolean,waves:boolean>")
    given = lambda over, default: F.when(F.coalesce(over, F.lit(0)) > 0, over).otherwise(default).cast("int")
    for name, (c, p, stop, waves) in MODES.items():
        out = F.when(mode == name, F.struct(given(cap, c).alias("cap"), given(page, p).alias("page"), F.lit(stop).alias("yield_stop"), F.lit(waves).alias("waves"))).otherwise(out)
    return out


# Words of questions.
QUESTION_OUTCOMES = {
    "muscle_function": r"\bsarcopenia\b|\bmuscle\b|\blean mass\b|\bstrength\b", "frailty": r"\bfrailty\b|\bgait speed\b|\bgrip strength\b|\bphysical function\b", "cardiometabolic": r"\bcardiovascular\b|\bcardiometabolic\b|\bglucose\b|\bhba1c\b|\blipid\b|\bweight\b|\bbmi\b",
    "cognitive": r"\bcognition\b|\bcognitive\b|\bdementia\b|\balzheimer|\bmemory\b", "longevity": r"\blongevity\b|\bhealthspan\b|\blifespan\b|\bmortality\b|\bsurvival\b", "immune": r"\binflammation\b|\bimmune\b|\bvaccine\b", "safety": r"\bsafety\b|\badverse\b|\btolerability\b",
    "oncology": r"\bcancer\b|\boncology\b|\btumou?r\b", "mechanism": r"\bmechanism\b|\bmtor\b|\bampk\b|\bautophagy\b|\bsenescence\b",
}
QUESTION_PEOPLE = {"non-diabetic older adults": r"\bnon[- ]diabetic older adults\b", "T2D": r"\b(?:t2d|type\s*2 diabetes|diabetic patients?)\b", "obesity": r"\b(?:obesity|obese)\b", "older adults": r"\b(?:older adults|elderly|geriatric)\b", "healthy adults": r"\bhealthy adults?\b"}
COMORBIDITIES = {"T2D": r"\b(?:t2d|type\s*2 diabetes)\b", "obesity": r"\b(?:obesity|obese)\b", "CKD": r"\b(?:ckd|chronic kidney disease)\b", "cardiovascular disease": r"\b(?:cvd|cardiovascular disease)\b"}


#: Fixed value: the end of an age range that names none.
OLDEST = 120


def age_range(low: Column) -> Column:
    """array(from, to) of the ages that a lower-cased question names: `65+`, `aged 40 to 60`, `over 70`, `under 18`, the first that fits; else null."""
    at = lambda p, g=1: F.nullif(F.regexp_extract(low, p, g), F.lit("")).cast("int")
    plus, between, over, under = r"\b(\d{2,3})\s*\+", r"\b(?:aged?|ages?)\s*(\d{2,3})\s*(?:-|to)\s*(\d{2,3})\b", r"\b(?:over|older than|at least|>=)\s*(\d{2,3})\b", r"\b(?:under|younger than|<)\s*(\d{2,3})\b"
    return F.coalesce(
        F.when(at(plus).isNotNull(), F.array(at(plus), F.lit(OLDEST))), F.when(at(between).isNotNull(), F.array_sort(F.array(at(between), at(between, 2)))),
        F.when(at(over).isNotNull(), F.array(at(over), F.lit(OLDEST))), F.when(at(under).isNotNull(), F.array(F.lit(0), at(under))),
    )


def question(text: Column) -> dict[str, Column]:
    """What a question names: outcomes in order of their place, people, ages, comorbidities, and interventions."""
    q = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    low = F.lower(q)
    found = lambda patterns: F.filter(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())
    people = F.get(found(QUESTION_PEOPLE), F.lit(0))
    span = F.coalesce(missing(F.regexp_extract(q, r"(?i)\b(?:about|evidence\s+(?:for|on)|effects?\s+of|impact\s+of|role\s+of)\s+(.+)$", 1)), missing(F.regexp_extract(q, r"(?i)^(.+?)\s+(?:for|on)\b", 1)))
    bare = F.regexp_replace(F.regexp_replace(span, r"(?i)^(?:what\s+does\s+(?:the\s+)?evidence\s+say\s+|what\s+is\s+(?:the\s+)?evidence\s+|does\s+|do\s+|can\s+)", ""), r"(?i)\s+(?:for|on|in|among|with|patients?|adults?|people)\b.*$", "")
    terms = F.filter(F.transform(F.split(F.regexp_replace(bare, r"[?.!,]+$", ""), r"(?i)\s+(?:vs\.?|versus|compared\s+with|and|or)\s+"), lambda t: F.lower(F.btrim(t, F.lit(" ,.;:?")))), lambda t: ~t.isin("", "the", "evidence"))
    terms = F.array_distinct(terms)
    placed = F.array(*[F.when(low.rlike(p), F.struct(F.regexp_instr(low, F.lit(p)).alias("at"), F.lit(k).alias("k"))) for k, p in QUESTION_OUTCOMES.items()])
    outcomes = F.transform(F.array_sort(F.filter(placed, lambda x: x.isNotNull())), lambda x: x["k"])
    return {"outcomes": outcomes, "people": people, "age": age_range(low), "comorbidities": F.filter(found(COMORBIDITIES), lambda c: ~c.eqNullSafe(people)), "interventions": F.coalesce(terms, F.array().cast("array<string>"))}


def plain_words(c: Column) -> Column:
    """Lower-case words without marks and without the s of a plural."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, 1, F.length(w) - 1)).otherwise(w)), " ")


def matched_topics(asked: DataFrame, packs: DataFrame) -> DataFrame:
    """(id, topic, score) of asked(id, term) against packs(topic, alias): 3 for an equal name, 1 for one within the other.

    Equal names are joined; names within one another share a word and are joined by words first.
    """
    a = asked.select("id", plain_words(F.col("term")).alias("t")).where("t <> ''").distinct()
    p = packs.select("topic", plain_words(F.col("alias")).alias("s")).where("s <> ''").distinct()
    wa, wp = a.select("id", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("w")), p.select("topic", "s", F.explode(F.array_distinct(F.split("s", " "))).alias("w"))
    met = wa.join(wp, "w").select("id", "t", "topic", "s").distinct()
    score = F.when(F.col("t") == F.col("s"), 3).when(F.contains("t", F.col("s")) | F.contains("s", F.col("t")), 1).otherwise(0)
    return met.select("id", "topic", score.alias("score")).groupBy("id", "topic").agg(F.max("score").alias("score")).where("score > 0")
