"""Provenance: what was made from what, by whom, and whether it still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import missing, normalize_doi
from weft.operators.verdicts import named

SCHEMA_VERSION = "1.0"
# States of a source in a retrieval, the stronger later.
SOURCE_STATES = ("enabled", "failed", "succeeded")
GENERIC_TITLE_WORDS = ("study", "trial", "review", "effect", "effects", "analysis", "clinical", "patients", "randomized", "controlled", "with", "from")


def content_hash(text: Column) -> Column:
    """sha256 of a text whose line ends and trailing white space do not count."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"(?m)[ \t]+$", "")
    return F.sha2(F.rtrim(lines, F.lit("\n")), 256)


def provenance(artifacts: DataFrame) -> DataFrame:
    """(run, record): JSON of artifacts(run, name, content, author, reviewers, verdict, made_at), keys in order."""
    fields = F.struct(
        F.col("name").alias("artifact"), F.col("author").alias("author_model"), F.col("made_at").alias("generated_at"), F.col("reviewers").alias("reviewer_models"), F.col("run").alias("run_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.sha2("content", 256).alias("sha256"), "verdict",
    )
    return artifacts.select("run", F.to_json(fields).alias("record"))


def verified(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(run, intact): whether the artifact that a record names is there with the recorded hash."""
    r = records.select("run", F.get_json_object("record", "$.artifact").alias("name"), F.get_json_object("record", "$.sha256").alias("was"))
    now = artifacts.select("run", "name", F.sha2("content", 256).alias("now"))
    return r.join(now, ["run", "name"], "left").select("run", F.coalesce(missing(F.col("was")) == F.col("now"), F.lit(False)).alias("intact"))


def consistency(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """(run, failures): checks of runs(run, paper, mirror, export, receipts, references) against registry(run, label).

    A paper must be there; a mirror and an export that are there must tell the same
    text; receipts must be more than none; every registered label must be in the references.
    """
    lost = registry.join(runs.select("run", "references"), "run").where(~F.contains(F.coalesce("references", F.lit("")), F.col("label"))).groupBy("run").agg(F.count("*").alias("lost"))
    labels = registry.groupBy("run").agg(F.count("*").alias("labels"))
    same = lambda c: F.col(c).isNotNull() & (content_hash(F.col(c)) != content_hash(F.col("paper")))
    rows = runs.join(lost, "run", "left").join(labels, "run", "left")
    return rows.select("run", named({
        "paper_present": F.col("paper").isNull(), "submission_package_match": F.col("paper").isNotNull() & same("mirror"), "export_match": F.col("paper").isNotNull() & same("export"), "manifest_receipt_count": F.coalesce("receipts", F.lit(0)) <= 0,
        "citation_registry_coverage": F.col("labels").isNull() | (F.coalesce("lost", F.lit(0)) > 0),
    }).alias("failures"))


def candidate_binding(topic: Column, code: Column, corpus: Column, receipts: Column, review_type: Column, policy: Column) -> Column:
    """struct(candidate_id, code, policy, corpus, receipts) of hashes; null if one is malformed or a name is missing."""
    t, c, h, r, k = (F.trim(F.coalesce(x, F.lit(""))) for x in (topic, code, corpus, receipts, review_type))
    ok = (t != "") & (k != "") & c.rlike("^[0-9a-f]{7,40}$") & h.rlike("^[0-9a-f]{64}$") & r.rlike("^[0-9a-f]{64}$")
    who = F.to_json(F.struct(h.alias("corpus_hash"), r.alias("receipt_set_hash"), k.alias("review_type"), t.alias("topic")))
    return F.when(ok, F.struct(F.sha2(who, 256).alias("candidate_id"), c.alias("code_sha"), F.sha2(policy, 256).alias("policy_hash"), h.alias("corpus_hash"), r.alias("receipt_set_hash")))


def snapshot(receipts: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """receipts with the hash of their files(key, content) and of their own fields: what a revision is frozen with."""
    fields = [c for c in receipts.columns if c != key]
    of = files.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("content", 256))), ""), 256).alias("files_sha256"))
    return receipts.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*fields)), 256)).join(of, key, "left")


def drifted(frozen: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, problem): rows of a snapshot that were lost, added, or changed in their fields or files."""
    a, b = frozen.select(key, F.col("row_sha256").alias("r0"), F.col("files_sha256").alias("f0"), F.lit(True).alias("was")), now.select(key, F.col("row_sha256").alias("r1"), F.col("files_sha256").alias("f1"), F.lit(True).alias("is_"))
    problem = F.when(F.col("is_").isNull(), "lost").when(F.col("was").isNull(), "added").when(F.col("r0") != F.col("r1"), "fields").when(~F.col("f0").eqNullSafe(F.col("f1")), "files")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def id_audit(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(row, mismatch): rows(row, pmid, title, doi) whose registry record(pmid, title, doi) is missing or tells otherwise.

    Titles match if one holds the other or three quarters of their words agree; a title
    alone must have two informative words and some length.
    """
    told = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z0-9]+"), 0)
    r = registry.select(F.trim("pmid").alias("pmid"), told("title").alias("t1"), normalize_doi(F.col("doi")).alias("d1"), F.lit(True).alias("there"))
    own = rows.where(missing(F.trim("pmid")).isNotNull()).select("row", F.trim("pmid").alias("pmid"), told("title").alias("t0"), normalize_doi(F.col("doi")).alias("d0"))
    j = own.join(r, "pmid", "left")
    w0, w1 = F.array_distinct("t0"), F.array_distinct("t1")
    close = F.contains(F.array_join("t1", " "), F.array_join("t0", " ")) | (F.size(F.array_intersect(w0, w1)) / F.greatest(F.size(F.array_union(w0, w1)), F.lit(1)) >= 0.75)
    rich = (F.size(F.filter(w0, lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_TITLE_WORDS))) >= 2) & ((F.size("t0") >= 5) | (F.length(F.array_join("t0", " ")) >= 30))
    titled = F.size("t0") > 0
    bad = named({
        "record_missing": F.col("there").isNull(), "title": F.col("there").isNotNull() & titled & ~close, "doi": F.col("there").isNotNull() & F.col("d0").isNotNull() & ~F.col("d0").eqNullSafe(F.col("d1")),
        "title_under_specified": F.col("there").isNotNull() & titled & F.col("d0").isNull() & ~rich,
    })
    return j.select("row", F.explode_outer(bad).alias("mismatch")).where("mismatch is not null")


def frozen_retrieval(states: DataFrame, by: str) -> DataFrame:
    """(by, sources, succeeded, failed, pending, summary) of states(by, source, state): a source's strongest state counts."""
    order = F.array_position(F.array(*map(F.lit, SOURCE_STATES)), F.lower(F.trim("state")))
    one = states.where(missing(F.trim("source")).isNotNull()).groupBy(by, F.trim("source").alias("source")).agg(F.max(order).alias("k")).where("k > 0")
    g = one.groupBy(by).agg(F.count("*").alias("sources"), F.count_if(F.col("k") == 3).alias("succeeded"), F.count_if(F.col("k") == 2).alias("failed"), F.count_if(F.col("k") == 1).alias("pending"))
    return g.withColumn("summary", F.format_string("%d enabled; %d succeeded; %d failed; %d enabled without a recorded outcome", "sources", "succeeded", "failed", "pending"))


def retained(log: DataFrame, receipts: DataFrame, reason: str) -> DataFrame:
    """log(source, included, reason) with included sources that no receipt(source) has marked as excluded, for a reason."""
    own = receipts.select("source").distinct().withColumn("_kept", F.lit(True))
    dropped = F.col("included") & F.col("_kept").isNull()
    return log.join(own, "source", "left").select("source", (F.col("included") & ~dropped).alias("included"), F.when(dropped, reason).otherwise(F.col("reason")).alias("reason"))


def costs(calls: DataFrame, model: str, cost: str) -> DataFrame:
    """(model, cost) to six places."""
    return calls.groupBy(model).agg(F.round(F.sum(cost), 6).alias("cost"))
