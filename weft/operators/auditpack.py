"""What an audit pack says of a run: references, assessments, publications, and whether to ship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of a publication's time, in order of preference, and of lists in a payload.
TIME_KEYS = ("publishedAt", "published_at", "createdAt", "created_at", "updatedAt", "updated_at")
LIST_KEYS = ("publications", "items", "rows", "results", "data")


def bare_doi(doi: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(doi, F.lit("")))), r"^https://doi\.org/", ""), r"^doi\.org/", "")


def references(registry: DataFrame, retracted: DataFrame) -> DataFrame:
    """registry(run, reference_id, doi, pmid, pmcid, ...) with resolved (some identifier is there) and retracted (its DOI is in retracted(doi))."""
    bad = retracted.select(bare_doi(F.col("doi")).alias("_doi")).where("_doi <> ''").distinct().withColumn("_bad", F.lit(True))
    any_ = F.concat_ws("", *[F.trim(F.coalesce(c, F.lit(""))) for c in ("doi", "pmid", "pmcid")]) != ""
    return registry.withColumn("_doi", bare_doi(F.col("doi"))).join(bad, "_doi", "left").select(*registry.columns, any_.alias("resolved"), F.col("_bad").isNotNull().alias("retracted"))


def ship_recommendation(verdicts: DataFrame, refs: DataFrame) -> DataFrame:
    """(run, advice) of verdicts(run, p1_clean, all_green, journal_ready, checked) and references(): the first reason to block, else ship or caveat.

    checked says that the list of retractions could be had. Where p1_clean is not known, all_green stands for it.
    """
    counts = refs.groupBy("run").agg(F.count_if("retracted").alias("_bad"), F.count_if(~F.col("resolved")).alias("_open"))
    clean = F.coalesce("p1_clean", "all_green", F.lit(False))
    advice = (
        F.when(F.col("_bad") > 0, "BLOCK — cites a retracted source").when(F.col("_open") > 0, "BLOCK — unresolved references").when(~F.coalesce("checked", F.lit(False)), "BLOCK — retraction check unavailable")
        .when(~clean, "BLOCK — unresolved P1 / not all-green").when(F.coalesce("all_green", F.lit(False)) & F.coalesce("journal_ready", F.lit(False)), "SHIP — all gates green and journal-ready")
        .otherwise("CAVEAT — below journal-ready bar; human review advised")
    )
    return verdicts.join(counts, "run", "left").select("run", advice.alias("advice"))


def quality_payloads(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(risk-of-bias rows, GRADE rows) of receipts(ord, citation_token, paper_id, receipt_id, outcome, rob_study, grade_outcome, ...).

    A risk-of-bias row must name the receipt it stands in; a GRADE row its outcome, of which the first counts.
    """
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    own = F.filter(F.array(*[norm(F.col(c)) for c in ("citation_token", "paper_id", "receipt_id")]), lambda x: x != "")
    bias = receipts.where((norm(F.col("rob_study")) != "") & F.array_contains(own, norm(F.col("rob_study"))))
    outcome = F.lower(F.coalesce(F.nullif(F.col("outcome"), F.lit("")), F.lit("other")))
    graded = receipts.where((norm(F.col("grade_outcome")) != "") & (norm(F.col("grade_outcome")) == outcome)).withColumn("key", outcome)
    first = graded.groupBy("key").agg(F.min("ord").alias("ord"))
    return bias, graded.join(first, ["key", "ord"], "left_semi")


def understated(domains: DataFrame, studies: DataFrame, scale: list[str]) -> DataFrame:
    """(study, stated, worst): studies(study, stated) whose rating is better than that of their worst domain of domains(study, rating)."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(scale) for x in (s, i)])
    worst = domains.groupBy("study").agg(F.max(F.try_element_at(rank, F.col("rating"))).alias("_w"))
    names = F.array(*map(F.lit, scale))
    return studies.join(worst, "study").where(F.try_element_at(rank, F.col("stated")) < F.col("_w")).select("study", "stated", F.get(names, F.col("_w")).alias("worst"))


def payload_rows(payload: Column) -> Column:
    """The rows of a payload, as JSON texts: it is a list, or has one under a known key, or under another one that holds objects."""
    as_list = lambda text: F.from_json(text, "array<string>")
    objects = lambda a: F.filter(a, lambda x: x.startswith("{"))
    known = F.coalesce(*[F.when(F.get_json_object(payload, f"$.{k}").startswith("["), objects(as_list(F.get_json_object(payload, f"$.{k}")))) for k in LIST_KEYS])
    others = F.filter(F.transform(F.filter(F.map_values(F.from_json(payload, "map<string, string>")), lambda v: v.startswith("[")), lambda v: objects(as_list(v))), lambda a: F.size(a) > 0)
    return F.coalesce(F.when(F.ltrim(payload).startswith("["), objects(as_list(payload))), known, F.get(others, F.lit(0)), F.array().cast("array<string>"))


def parsed_time(text: Column) -> Column:
    """An ISO time, UTC where it names no zone; null for anything else."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    zoned = plain.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.when(zoned | ~plain.rlike(r"\d{2}:\d{2}"), plain).otherwise(F.concat(plain, F.lit("+00:00")))))


def latest_publication(rows: DataFrame, by: str, row: str) -> DataFrame:
    """(by, latest): the latest time of rows(by, row as JSON); of each row the first key counts that holds a time."""
    at = F.coalesce(*[parsed_time(F.get_json_object(row, f"$.{k}")) for k in TIME_KEYS])
    return rows.groupBy(by).agg(F.max(at).alias("latest"))


def is_public_paper(row: Column, agents: list[str]) -> Column:
    """A JSON row is a research paper of one of the agents that was accepted and can be seen."""
    get = lambda *keys: F.coalesce(*[F.nullif(F.get_json_object(row, f"$.{k}"), F.lit("")) for k in keys], F.lit(""))
    seen = F.coalesce(*[F.nullif(F.get_json_object(row, f"$.{k}"), F.lit("false")) for k in ("publicVisible", "public_visible", "published")], F.lit("")) == "true"
    return get("agentId", "agent_id").isin(*agents) & (get("artifactType", "artifact_type") == "research_paper") & F.lower(get("decision")).isin("accept", "accepted") & seen


def source_inventory(sources: DataFrame, by: str) -> DataFrame:
    """(by, enabled, succeeded, failed, pending) of sources(by, source, status)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return sources.groupBy(by).agg(F.count("*").alias("enabled"), n("succeeded").alias("succeeded"), n("failed").alias("failed"), n("enabled").alias("pending"))


def exclusion_reasons(entries: DataFrame, by: str) -> DataFrame:
    """(by, reason, n) of entries(by, keep_for_extraction, reason) that were not kept."""
    out = entries.where(~F.coalesce("keep_for_extraction", F.lit(True)))
    return out.groupBy(by, F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("Reason not recorded")).alias("reason")).agg(F.count("*").alias("n"))


def framework_of(topic: Column, topic_class: Column, outcomes: Column, frameworks: list[tuple[str, list[str]]], most: int = 40) -> Column:
    """The first framework with a term in the topic, its class or its first `most` outcomes; else the last of the list."""
    said = F.lower(F.concat_ws(" ", topic, topic_class, F.array_join(F.slice(outcomes, 1, most), " ")))
    out = F.lit(frameworks[-1][0])
    for name, terms in reversed(frameworks):
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(said, F.lit(t))
        out = F.when(hit, name).otherwise(out)
    return out
