"""Which topic comes next: what ledgers of attempts, submissions and reviews say about each.

Ledgers are tables of rows with a time; windows are cut at `now`, which is an argument.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import missing
from weft.operators.verdicts import named

# Classes of failure, statuses that never count as repeats, floors.
FAILURE_CLASS = {
    "journal_surface_not_passed": "A_compiler_fixable",
    "journal_surface_failed": "A_compiler_fixable",
    "final_status_not_ready": "A_compiler_fixable",
    "final_verdict_not_aaa": "A_compiler_fixable",
    "pre_submit_not_passed": "A_compiler_fixable",
    "needs_corpus_expansion": "B_corpus_fixable",
    "audit_not_all_green": "C_writer_fixable",
    "revision_coverage_unmet": "C_writer_fixable",
    "numeric_effect_mismatch": "C_writer_fixable",
    "abstract_overclaim": "C_writer_fixable",
    "retracted_source_cited": "D_no_action",
    "synthesis_failed": "C_writer_fixable",
    "local_gate_blocked": "C_writer_fixable",
    "local_gate_execution_failed": "D_no_action",
    "synthesis_timeout": "D_no_action",
    "writer_unavailable": "D_no_action",
    "cycle_budget_exhausted": "D_no_action",
    "submission_revise_requested": "C_writer_fixable",
    "strategy_evidence_insufficient": "B_corpus_fixable",
    "source_topic_precision_low": "B_corpus_fixable",
    "recency_ratio_low": "B_corpus_fixable",
    "preflight_insufficient_corpus": "B_corpus_fixable",
    "preflight_thin_quant_corpus": "B_corpus_fixable",
    "corpus_missing_dry_run": "B_corpus_fixable",
    "corpus_seed_empty": "B_corpus_fixable",
    "corpus_seed_failed": "B_corpus_fixable",
    "receipt_preflight_insufficient": "B_corpus_fixable",
    "public_research_surface_compact_review": "B_corpus_fixable",
    "public_research_surface_insufficient": "B_corpus_fixable",
    "audit_p1_failed": "C_writer_fixable",
    "missing": "C_writer_fixable",
    "superseded_topic_run": "D_no_action",
    "topic_already_submitted_pending": "D_no_action",
    "terminal_synthesis_timeout": "D_no_action",
}
TERMINAL_REVISION = ("duplicate_remote_publication", "duplicate_submission_fingerprint", "research_revision_fingerprint", "retracted_source_cited", "terminal_revision_source_manifest_unavailable", "terminal_receipt_preflight_insufficient", "terminal_surface_repeat", "terminal_source_precision_repair_incomplete")
ACTIVE_TERMINAL_REVISION = ("terminal_domain_scope_mismatch", "terminal_latest_run_missing_manifest", "terminal_preflight_insufficient_corpus", "terminal_revision_trace_evidence_insufficient")
NEVER_REPEATS = ("", "eligible", "submitted", "cycle_budget_exhausted", "current_run_not_submitted", "synthesis_failed", "synthesis_timeout", "terminal_synthesis_timeout", "corpus_seed_failed", "writer_unavailable", "terminal_surface_repeat")
PREFLIGHT = ("corpus_missing_dry_run", "corpus_seed_empty", "preflight_insufficient_corpus", "preflight_thin_quant_corpus", "receipt_preflight_insufficient", "source_bundle_topic_mismatch", "source_bundle_unmapped_sources")
PRIMARY = ("A1", "A2", "B1")
IDLE_DAYS = 14


def _in_window(ts: str, now: Column, hours: int) -> Column:
    return F.col(ts) >= now - F.expr(f"interval {hours} hours")


def code_of(status: Column) -> Column:
    """The part of a status before its first colon."""
    return F.split_part(F.coalesce(status, F.lit("")), F.lit(":"), F.lit(1))


def failure_class(status: Column, classes: dict[str, str] | None = None, default: str = "unknown") -> Column:
    """The class of a status: none is left to do once a revision ended for good.

    Statuses of a deployment's own submission service come as `classes`, which add to the table.
    """
    table = F.create_map(*[F.lit(x) for p in {**FAILURE_CLASS, **(classes or {})}.items() for x in p])
    code = code_of(status)
    return F.when(code.isin(*TERMINAL_REVISION, *ACTIVE_TERMINAL_REVISION), "D_no_action").otherwise(F.coalesce(F.try_element_at(table, code), F.lit(default)))


def manifest_counts(receipts: DataFrame, by: str) -> DataFrame:
    """(by, receipts, primary_tier, direct_receipts, outcome_classes); where no receipt states a
    directness, primary ones count as direct."""
    primary = F.count_if(F.upper(F.coalesce("tier", F.lit(""))).isin(*PRIMARY))
    direct = F.count_if(F.lower("directness") == "direct")
    return receipts.groupBy(by).agg(
        F.count("*").alias("receipts"), primary.alias("primary_tier"), F.when(F.bool_or(F.col("directness").isNotNull()), direct).otherwise(primary).alias("direct_receipts"), F.countDistinct(missing(F.trim("outcome"))).alias("outcome_classes"),
    )


def run_stats(runs: DataFrame, topic: str, level: str) -> DataFrame:
    """(topic, runs, certified): runs, and those of level 4 or more."""
    return runs.groupBy(topic).agg(F.count("*").alias("runs"), F.count_if(F.coalesce(level, F.lit(0)) >= 4).alias("certified"))


def attempt_history(attempts: DataFrame, topic: str, ts: str, submitted: Column, now: Column, hours: int) -> DataFrame:
    """(topic, last, failures): the last attempt, and those without a submission inside the window."""
    return attempts.groupBy(topic).agg(F.max(ts).alias("last"), F.count_if(_in_window(ts, now, hours) & ~submitted).alias("failures"))


def repeated_surface(stamps: DataFrame, ready: DataFrame, now: Column, hours: int, threshold: int) -> DataFrame:
    """(topic): one gate failed `threshold` times inside the window of stamps(topic, code, ts), it is not one that a
    writer or a preflight mends, and no ready(topic, ts) artifact is newer than the last failure."""
    own = stamps.where((F.col("topic") != "") & ~F.col("code").isin(*NEVER_REPEATS, *PREFLIGHT) & ~failure_class(F.col("code"), default="").startswith("C_") & _in_window("ts", now, hours))
    failed = own.groupBy("topic", "code").agg(F.count("*").alias("n"), F.max("ts").alias("last")).where(F.col("n") >= threshold)
    newest = ready.groupBy("topic").agg(F.max("ts").alias("ready"))
    return failed.join(newest, "topic", "left").where(F.col("ready").isNull() | (F.col("ready") <= F.col("last"))).select("topic").distinct()


def recent_blocked(stamps: DataFrame, now: Column, hours: int, codes: list[str] | None = None) -> DataFrame:
    """(topic): topics with a stamp of one of the codes, or of any that counts, inside the window."""
    wanted = F.col("code").isin(*codes) if codes is not None else ~F.col("code").isin(*NEVER_REPEATS)
    return stamps.where((F.col("topic") != "") & wanted & _in_window("ts", now, hours)).select("topic").distinct()


def unrepairable(attempts: DataFrame, now: Column, hours: int) -> DataFrame:
    """(topic): attempts(topic, ts, repair) inside the window whose repair, as JSON, ended incomplete with no claim."""
    status = F.get_json_object("repair", "$.status")
    claims = F.coalesce(F.get_json_object("repair", "$.n_quant_claims").cast("long"), F.lit(0))
    return attempts.where(_in_window("ts", now, hours) & (status == "source_precision_repair_incomplete") & (claims == 0) & missing(F.col("topic")).isNotNull()).select("topic").distinct()


def normal_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def title_markers(title: Column) -> Column:
    """Keys that a title is known by: itself, without its closing "full paper", and what follows a colon in either."""
    raw = F.trim(F.coalesce(title, F.lit("")))
    bare = F.trim(F.regexp_replace(raw, r"(?i)\s+[—-]\s+full paper\s*$", ""))
    tail = lambda x: F.when(F.contains(x, F.lit(":")), missing(F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1))))
    keys = F.transform(F.filter(F.array(missing(raw), missing(bare), tail(raw), tail(bare)), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("title:"), normal_key(x)))
    return F.array_sort(F.array_distinct(keys))


def submitted_topics(topics: DataFrame, submissions: DataFrame, now: Column, days: int) -> DataFrame:
    """(topic): topics(topic, family) that were submitted ever, or whose family was inside the window, of submissions(topic, family, ts)."""
    exact = submissions.select(normal_key(F.col("topic")).alias("_k")).distinct()
    kin = submissions.where(F.col("ts") >= now - F.expr(f"interval {days} days")).select(F.col("family").alias("_f")).distinct()
    return topics.join(exact, normal_key(F.col("topic")) == F.col("_k"), "left_semi").select("topic").union(topics.join(kin, F.col("family") == F.col("_f"), "left_semi").select("topic")).distinct()


def published_topics(topics: DataFrame, markers: DataFrame, blocked: DataFrame) -> DataFrame:
    """(topic): blocked ones, and those that a published marker(marker) names as topic or as title."""
    seen = markers.select(F.col("marker").alias("_m")).distinct()
    titles = markers.where(F.col("marker").startswith("title:")).select(F.explode(title_markers(F.substring("marker", 7, 4000))).alias("_m"))
    keyed = topics.select("topic", F.explode(F.array(F.concat(F.lit("topic:"), normal_key(F.col("topic"))), F.concat(F.lit("title:"), normal_key(F.replace("topic", F.lit("_"), F.lit(" ")))))).alias("_m"))
    return blocked.select("topic").union(keyed.join(seen.union(titles).distinct(), "_m", "left_semi").select("topic")).distinct()


# Words that put a reviewer's request into a bucket, the first that fits.
REVISE_BUCKETS = {
    "publication_overlap": ["overlap with publication", "already published", "duplicate submission"],
    "scope_mismatch": [
        "scope mismatch", "scope/title", "narrow the title", "research question", "does not match the corpus", "match the actual corpus", "title says", "mismatch between the title", "pico", "framing that does not match",
        "rename the title", "abstract omits", "synthesis question",
    ],
    "section_duplication": [
        "near-verbatim duplicate", "verbatim", "repeated", "repeating", "duplicated", "duplicates content", "redundant", "boilerplate", "templated", "placeholder", "corrupted", "meta-commentary", "scaffolding", "restatement",
        "collapsing redundant",
    ],
    "table_without_numbers": ["no actual numeric", "aggregate counts", "no numeric", "without numeric", "no effect sizes", "beyond 'positive", "only enumerates source-level"],
    "direction_coding": [
        "mis-coded", "miscoded", "coded as", "coded positive", "coded 'positive'", "labeled \"null\"", "labeled 'null'", "labelled", "labels ", "direction profile", "direction assignments", "direction synthesis", "directional coding",
        "coded null", "polarity", "coded direct", "directness coding", "recode", "coding is consistent", "coding is internally", "orient positive", "outcome-class allocation", "direction code",
    ],
    "methods_accounting": [
        "inclusion funnel", "auditable", "selection flow", "retrieved records", "search summary", "search strategy", "search window", "query list", "database coverage", "retrieval date", "admitted sources", "exclusion counts",
        "eligibility criterion", "screening", "extraction qc", "future-dated", "publication dates", "dated 2025", "risk-of-bias", "rob ", "rob-2", "not visible to the reader", "methods_pack", "conference abstract", "conference-abstract",
        "justify its tier", "sample-size and follow-up",
    ],
    "citation_bundle_mismatch": [
        "exact source tokens", "exactly traceable", "identify a bundle source", "traceab", "could not be verified", "not present in the source_bundle", "not in the source bundle", "source-list mismatch", "attributions are inaccurate",
        "source attributions", "attribute each", "cited numbers", "citations that are not", "author-year", "cited source", "bundle excerpt", "bundle entries", "conflict between the abstract", "enumerate and locate", "remove the number",
        "cross-study disagreements", "tensions and gaps", "name the specific sources", "itemize the specific", "without citing", "broken author token", "misattributed", "misattribution", "does not cite", "incorrectly describes",
        "incorrectly states", "completeness claim", "primary evidence anchor", "invalid at indices",
    ],
    "directness_honesty": [
        "direct clinical", "direct interventional", "indirect", "adjacent", "mechanistic", "overclaim", "hypothesis-generating", "broad population-level proof", "no direct", "single-source", "does not directly test", "not directly",
        "stand-alone intervention", "direct sources", "direct-rct", "add-on or comparator",
    ],
    "null_signal_reconciliation": ["null directional", "no extracted directional signal", "no directional signal", "strongest signal", "reconcile", "supports", "bounded rationale"],
    "source_relevance_classification": [
        "source bundle", "source directness", "source classification", "outcome class", "evidence_type", "evidence type", "off-topic", "operationalize", "included under", "misclassified", "reclassify", "protocol",
        "belongs in the synthesis", "clarify why it is in", "weakly relevant", "not a results paper", "reframe", "justify inclusion", "meta-analysis' label", "source-role",
    ],
    "numeric_claim_rigor": [
        "p-value", "p value", "confidence interval", "significant", "non-significant", "effect direction", "factual error", "statistic", "numeric", "hedged", "hedge", "primary endpoint", "contradiction", "contradicts", "pooled",
        "power rationale", "misattribution",
    ],
    "readability_redundancy": [
        "repetitive", "duplication", "truncated", "grammatical", "readability", "verbatim repetition", "readable", "formatting", "paragraph breaks", "paragraph structure", "self-contained", "garbled", "fragment", "capitalization",
        "inline label",
    ],
    "actionable_gaps": [
        "gaps identified", "actionable", "future research", "next steps", "concise list", "add an explicit background", "add a single sentence", "add one or two sentences", "expand the discussion",
    ],
}


def revise_bucket(text: Column) -> Column:
    low = normal_key(text)
    out = F.lit("unknown")
    for k, terms in reversed(REVISE_BUCKETS.items()):
        out = F.when(low.rlike("|".join(map(re.escape, terms))), k).otherwise(out)
    return out


def merged_asks(known: DataFrame, news: DataFrame) -> DataFrame:
    """(review, bucket, n): asks of known(review, at, text) with those of reviews in news put in their place; a review
    that news does not name stays."""
    old = known.join(news.select("review").distinct(), "review", "left_anti")
    return old.select("review", "at", "text").unionByName(news.select("review", "at", "text")).groupBy("review", revise_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))


def lessons(asks: DataFrame, now: Column, known: list[str], days: int = 30, cap: int = 8) -> DataFrame:
    """(bucket, n): the most frequent buckets of asks(bucket, at) in the window for which there is a lesson, `cap` at most."""
    own = asks.where((F.col("at") >= now - F.expr(f"interval {days} days")) & F.col("bucket").isin(*known))
    return own.groupBy("bucket").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket").limit(cap)


def publication_points(certified: Column, runs: Column, last: Column, failures: Column, now: Column) -> Column:
    """Five times the certified share, half to even, two for an idle topic, less two a failure."""
    idle = last.isNull() | (last < now - F.expr(f"interval {IDLE_DAYS} days"))
    share = F.when(runs > 0, certified / F.greatest(runs, F.lit(1))).otherwise(0.0)
    return F.bround(share * 5).cast("long") + F.when(idle, 2).otherwise(0) - 2 * failures


def support_points(candidates: Column, claims: Column) -> Column:
    return F.when(F.coalesce(candidates, F.lit(0)) > 0, candidates).otherwise(claims)


def fit_rank(receipts: Column, primary: Column, direct: Column, least: dict[str, int]) -> Column:
    """A struct that orders topics by how far their sources fall short, the best first."""
    gap = lambda k, x: F.greatest(F.lit(0), F.lit(least[k]) - x)
    r, p, d = gap("receipts", receipts), gap("primary_tier", primary), gap("direct_receipts", direct)
    none = receipts <= 0
    as_int = lambda c, x: F.when(none, x).otherwise(c).cast("int")
    status = F.when(none, 3).when((p + d) > 0, 2).when(r > 0, 1).otherwise(0)
    return F.struct(
        status.alias("status"), as_int(r, least["receipts"]).alias("receipt_gap"), as_int(p + d, least["receipts"]).alias("fit_gap"), as_int(p, least["primary_tier"]).alias("primary_gap"), as_int(d, least["direct_receipts"]).alias("direct_gap"),
        as_int(-direct, 0).alias("direct"), as_int(-primary, 0).alias("primary"), as_int(-receipts, 0).alias("receipts"),
    )


def preflight_counts(attempts: DataFrame, topic: str, ledger: str, started: str, order: str, counts: list[str], now: Column, hours: int) -> DataFrame:
    """(topic, counts...): of ledgers inside the window the newest that has the topic, and in it the last attempt."""
    last = attempts.where(_in_window(started, now, hours)).groupBy(topic, ledger).agg(F.max(started).alias("_s"), F.max_by(F.struct(*counts), order).alias("_c"))
    return last.groupBy(topic).agg(F.max_by("_c", F.struct("_s", ledger)).alias("c")).select(topic, "c.*")


def fresh_pool(topics: DataFrame, blocked: DataFrame, failing: DataFrame, exempt: DataFrame) -> DataFrame:
    """(topic): topics that are not blocked, without the failing ones unless they are exempt; all that are
    not blocked if none is left. One row of counts decides."""
    open_ = topics.select("topic").distinct().join(blocked.select("topic").distinct(), "topic", "left_anti")
    marks = failing.select("topic").distinct().join(exempt.select("topic").distinct(), "topic", "left_anti").withColumn("_bad", F.lit(True))
    rows = open_.join(marks, "topic", "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    flag = rows.agg(F.coalesce(F.bool_or(~F.col("_bad")), F.lit(False)).alias("_any"))
    return rows.join(F.broadcast(flag)).where(~F.col("_any") | ~F.col("_bad")).select("topic")


def first_by(rows: DataFrame, key: str, rank: list[Column]) -> DataFrame:
    """The row whose rank is smallest, ties by key: one row."""
    return rows.agg(F.min_by(F.struct(*rows.columns), F.struct(*rank, F.col(key))).alias("r")).select("r.*")


def same_gate_failures(attempts: DataFrame, topic: str, status: str, submitted: Column) -> DataFrame:
    """(topic, code, failures) of attempts that were not submitted."""
    code = code_of(F.col(status))
    return attempts.where(~submitted & ~code.isin("", "eligible", "submitted")).groupBy(topic, code.alias("code")).agg(F.count("*").alias("failures"))


def retries(attempts: DataFrame, topic: str, klass: str, submitted: Column) -> DataFrame:
    """(topic, retries): attempts not submitted that a compiler or a writer can mend."""
    return attempts.groupBy(topic).agg(F.count_if(~submitted & F.col(klass).rlike("^[AC]_")).alias("retries"))


def source_precision(files: DataFrame, topic: str, specific: Column, on_entity: Column, floor: float, least: int) -> DataFrame:
    """(topic, hits, files, passed, how): the share of specific files against a floor; below it, enough files on the entity pass."""
    g = files.groupBy(topic).agg(F.count("*").alias("files"), F.count_if(specific).alias("hits"), F.count_if(on_entity).alias("core"))
    ok = F.col("hits") / F.col("files") >= floor
    return g.select(topic, "hits", "files", (ok | (F.col("core") >= least)).alias("passed"), F.when(ok, "ratio").when(F.col("core") >= least, "scoped_floor").otherwise("low").alias("how"))


def usable_files(files: DataFrame, topic: str, claims: str) -> DataFrame:
    """(topic, usable, files): files whose claims, JSON text of an array, are missing or bind something."""
    parsed = F.from_json(claims, "array<struct<binding_confidence:string>>")
    bound = F.exists(parsed, lambda c: F.lower(F.coalesce(missing(c["binding_confidence"]), F.lit("high"))) != "none")
    return files.groupBy(topic).agg(F.count_if(F.col(claims).isNull() | F.coalesce(bound, F.lit(False))).alias("usable"), F.count("*").alias("files"))


def source_floor(receipts: Column, citations: Column, floor: int = 12) -> Column:
    """eligible, or how far the lesser of receipts and citations is below the floor."""
    least = F.least(receipts, citations)
    return F.when(least < floor, F.concat(F.lit("preflight_insufficient_corpus:n_receipts="), least.cast("string"), F.lit(f" < threshold {floor}"))).otherwise("eligible")


def cited_rows(texts: DataFrame, bundle: DataFrame) -> DataFrame:
    """(id, position): rows of bundle(bundle, position, cited_as, pmid, doi) that a text(id, bundle, text) cites, by
    bracketed number, PMID or DOI, or by a label that it holds. A bundle has few rows; there may be many bundles."""
    low, lower = F.lower("text"), lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    by = F.concat(
        F.transform(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"), 1), lambda g: F.regexp_extract_all(g, F.lit("[0-9]+"), 0))), lambda n: F.concat(F.lit("n:"), n)),
        F.transform(F.regexp_extract_all(low, F.lit(r"\bpmid:?\s*([0-9]+)"), 1), lambda p: F.concat(F.lit("p:"), p)),
        F.transform(F.regexp_extract_all(low, F.lit(r"\b(10\.[0-9]{4,9}/[^\s\]\)]+)"), 1), lambda d: F.concat(F.lit("d:"), F.rtrim(d, F.lit(".,")))),
    )
    keys = F.array(F.concat(F.lit("n:"), F.col("position").cast("string")), F.concat(F.lit("p:"), missing(F.regexp_replace(F.col("pmid"), r"\D", ""))), F.concat(F.lit("d:"), missing(F.rtrim(lower(F.col("doi")), F.lit(".,")))))
    own = bundle.select("bundle", "position", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))
    # Merged: Spark takes what an explode gives for no larger than what it is given, and would broadcast all bundles.
    exact = texts.select("id", "bundle", F.explode(F.array_distinct(by)).alias("key")).join(own.hint("merge"), ["bundle", "key"]).select("id", "position")
    labels = bundle.select("bundle", "position", lower(F.col("cited_as")).alias("label")).where(F.length("label") >= 4)
    named_ = texts.select("id", "bundle", low.alias("low")).join(labels.hint("merge"), "bundle").where(F.contains("low", F.col("label"))).select("id", "position")
    return exact.union(named_).distinct()


def day_summary(ledgers: DataFrame, day: str, durable: DataFrame) -> DataFrame:
    """(day, submitted, published): the largest of what ledgers and durable(day, submitted) say."""
    g = ledgers.groupBy(day).agg(F.max("submitted").alias("s"), F.max("published").alias("published"))
    return g.join(durable.groupBy(day).agg(F.max("submitted").alias("d")), day, "left").select(day, F.greatest("s", F.coalesce("d", F.lit(0))).alias("submitted"), "published")


def triage(ledgers: DataFrame, ts: str, reason: Column, limit: int = 12, k: int = 8) -> DataFrame:
    """(reason, n): why the latest `limit` ledgers ended, the k most frequent."""
    last = ledgers.orderBy(F.desc(ts), *[F.desc(c) for c in ledgers.columns if c != ts]).limit(limit)
    return last.groupBy(F.coalesce(missing(reason), F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def ledger_names(ledgers: DataFrame) -> DataFrame:
    """(ledger, run): runs that a ledger, JSON text, names: its own, its candidate's, and those of attempts and submissions that were submitted."""
    j = F.from_json("payload", "submitted_run string, attempted_run string, out_dir string, candidate struct<run:string>, attempts array<struct<submitted:int,submitted_run:string,out_dir:string>>, submissions array<struct<submitted:int,candidate:struct<run:string>>>")
    rows = ledgers.select("ledger", j.alias("j"))
    done = lambda a: F.filter(F.coalesce(a, F.array()), lambda r: F.coalesce(r["submitted"], F.lit(0)) != 0)
    tries = F.flatten(F.transform(done(F.col("j.attempts")), lambda r: F.array(r["submitted_run"], r["out_dir"])))
    sent = F.transform(done(F.col("j.submissions")), lambda r: r["candidate"]["run"])
    names = F.concat(F.array("j.submitted_run", "j.attempted_run", "j.out_dir", "j.candidate.run"), tries, sent)
    return rows.select("ledger", F.explode(F.array_distinct(F.filter(names, lambda n: missing(n).isNotNull()))).alias("run"))


def candidate_gaps(primary: Column, direct: Column, least: dict[str, int]) -> Column:
    """Which floors of sources a candidate misses."""
    return named({"n_primary_tier": primary < least["primary_tier"], "n_direct_receipts": direct < least["direct_receipts"]})
