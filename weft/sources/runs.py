"""Artifacts of synthesis runs, receipts and topic packs: files of one folder become one row.

Files are read whole as (path, content); the folder's name is the run. Required files
are put side by side by an aggregate over a declared list of names, parsed against
declared schemas, and a run that lacks one or has one that is no JSON object keeps its
row with the reason.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The files of a run and of a receipt.
VERDICT, MANIFEST, REGISTRY, CONTRACT = "full_paper.final_verdict.json", "manifest.json", "citation_registry.json", "public_manuscript_contract.json"
RECEIPT_FILES = ("run_metadata.json", "claim_graph.json", "spar_review.json", "evidence_cards.json")
VERDICT_SCHEMA = "verdict string, maturity_level int, maturity_label string, certification_track string, journal_ready boolean"
RECEIPTS = "receipt_id string, citation_token string, outcome_class string, directness string, evidence_tier string, effect_direction string"
MANIFEST_SCHEMA = f"n_receipts long, n_accepted_receipts long, n_non_orthogonal_tensions long, n_high_confidence_claims_total long, receipts array<struct<{', '.join(f.replace(' ', ':') for f in RECEIPTS.split(', '))}>>"
REGISTRY_SCHEMA = "map<string, struct<source_doi:string, source_pmid:string, source_pmcid:string>>"
MIXES = {"directness_mix": "directness", "evidence_tier_mix": "evidence_tier", "effect_direction_mix": "effect_direction"}


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content) of whole files. Spark's listing leaves empty files out, so those are missing."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("content").cast("string").alias("content"))


def artifacts(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(run, one column of content for each name): files(path, content) by folder; other files only tell that the folder is there."""
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("run"), F.element_at(parts, -1).alias("name"), "content")
    return named.groupBy("run").agg(*[F.max(F.when(F.col("name") == n, F.col("content"))).alias(n) for n in names])


def is_object(content: Column) -> Column:
    """The text is a JSON object; null is none."""
    begins = F.ltrim(content, F.lit(" \t\r\n")).startswith("{")
    return F.coalesce(begins & F.try_parse_json(content).isNotNull(), F.lit(False))


def counted(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """rows with a map for each name, of its array's values to how often they occur; null and empty count as unknown.

    Arrays and their distinct values are columns on the way, so that each is made once.
    """
    known = lambda v: F.coalesce(F.nullif(v, F.lit("")), F.lit("unknown"))
    rows = rows.withColumns({f"_all_{n}": F.transform(c, known) for n, c in values.items()})
    rows = rows.withColumns({f"_keys_{n}": F.sort_array(F.array_distinct(f"_all_{n}")) for n in values})
    often = lambda n: lambda k: (F.size(f"_all_{n}") - F.size(F.array_remove(f"_all_{n}", k))).cast("long")
    maps = {n: F.map_from_arrays(f"_keys_{n}", F.transform(f"_keys_{n}", often(n))) for n in values}
    return rows.withColumns(maps).drop(*[f"{k}{n}" for n in values for k in ("_all_", "_keys_")])


def eligibility(verdict: Column) -> Column:
    """What a verdict makes of a run: excluded, full_aaa_primary, analytical_support or scoped_support."""
    level = F.coalesce(verdict["maturity_level"], F.lit(0))
    return (
        F.when(~F.coalesce(verdict["verdict"] == "AAA", F.lit(False)), "excluded").when(F.contains(F.coalesce(verdict["certification_track"], F.lit("")), F.lit("SCOP")), "scoped_support")
        .when((level >= 5) & F.coalesce(verdict["journal_ready"], F.lit(False)), "full_aaa_primary").when(level >= 4, "analytical_support").otherwise("scoped_support")
    )


def _first_count(*counts: Column) -> Column:
    """The first count that is neither null nor zero, else zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("long")) for c in counts], F.lit(0).cast("long"))


def run_summaries(files: DataFrame) -> DataFrame:
    """One row a run: what its verdict, manifest, citation registry and, if there, contract say.

    A run without one of the first three, or with one that is no JSON object, is excluded,
    and exclusion_reason names the files. Counts of the contract come before the manifest's,
    whose own come before the number of receipts. Mixes are maps of counts.
    """
    required = (VERDICT, MANIFEST, REGISTRY)
    runs = artifacts(files, (*required, CONTRACT))
    listed = lambda bad: F.concat_ws(", ", *[F.when(bad(F.col(f"`{n}`")), F.lit(n)) for n in required])
    # A column of its own, so that files are parsed once for it, and only if none is missing.
    rows = runs.withColumn("_missing", listed(lambda c: c.isNull()))
    rows = rows.withColumn("_broken", F.when(F.col("_missing") == "", listed(lambda c: ~is_object(c))))
    reason = F.when(F.col("_missing") != "", F.concat(F.lit("missing artifacts: "), "_missing")).when(F.col("_broken") != "", F.concat(F.lit("unreadable artifacts: "), "_broken"))
    rows = rows.withColumn("exclusion_reason", reason)
    whole = lambda name, schema: F.when(F.col("exclusion_reason").isNull(), F.from_json(F.col(f"`{name}`"), schema))
    rows = rows.withColumn("v", whole(VERDICT, VERDICT_SCHEMA)).withColumn("m", whole(MANIFEST, MANIFEST_SCHEMA)).withColumn("r", whole(REGISTRY, REGISTRY_SCHEMA))
    rows = rows.withColumn("c", F.from_json(F.get_json_object(F.col(f"`{CONTRACT}`"), "$.canonical_counts"), "map<string, long>"))
    receipts = F.coalesce(F.col("m.receipts"), F.array().cast(f"array<struct<{', '.join(f.replace(' ', ':') for f in RECEIPTS.split(', '))}>>"))
    rows = rows.withColumn("s", receipts)
    count = lambda key: F.try_element_at("c", F.lit(key))
    papers = _first_count(count("source_papers"), F.col("m.n_receipts"), F.size("s").cast("long"))
    tensions = _first_count(count("tensions"), F.col("m.n_non_orthogonal_tensions"))
    named = lambda e: F.lower(F.coalesce(*[F.nullif(e["value"][k], F.lit("")) for k in ("source_doi", "source_pmid", "source_pmcid")], e["key"]))
    keys = F.array_sort(F.array_distinct(F.transform(F.map_entries(F.coalesce("r", F.create_map().cast(REGISTRY_SCHEMA))), named)))
    known = F.col("exclusion_reason").isNull()
    pairs = F.transform("s", lambda x: F.concat_ws("/", F.coalesce(F.nullif(x["outcome_class"], F.lit("")), F.lit("unknown")), F.coalesce(F.nullif(x["effect_direction"], F.lit("")), F.lit("unknown"))))
    rows = counted(rows, {**{n: _field(f) for n, f in MIXES.items()}, "outcome_effects": pairs})
    return rows.select(
        F.col("run").alias("run_id"), F.coalesce(F.nullif(F.regexp_extract("run", r"^synthesis-(.+?)-v\d+", 1), F.lit("")), F.col("run")).alias("topic"),
        F.when(known, eligibility(F.col("v"))).otherwise("excluded").alias("eligibility"), F.coalesce("v.verdict", F.lit("")).alias("verdict"), F.coalesce("v.maturity_level", F.lit(0)).alias("maturity_level"),
        F.coalesce("v.maturity_label", F.lit("")).alias("maturity_label"), F.coalesce("v.certification_track", F.lit("")).alias("certification_track"), F.coalesce("v.journal_ready", F.lit(False)).alias("journal_ready"),
        papers.alias("n_source_papers"), _first_count(count("accepted_papers"), F.col("m.n_accepted_receipts"), papers).alias("n_accepted_papers"), tensions.alias("n_public_tensions"),
        _first_count(F.col("m.n_non_orthogonal_tensions"), tensions).alias("n_pipeline_tensions"), _first_count(count("high_confidence_claims"), F.col("m.n_high_confidence_claims_total")).alias("n_high_confidence_claims"),
        *MIXES, "outcome_effects",
        F.array_sort(F.array_distinct(F.filter(_field("outcome_class"), lambda x: x != ""))).alias("outcome_domains"), keys.alias("citation_keys"), "exclusion_reason",
    )


def _field(name: str) -> Column:
    return F.transform("s", lambda x: x[name])


def field_citations(runs: DataFrame) -> DataFrame:
    """(citation_key, n_topics): every source of run_summaries(), and how many runs cite it; more than one is a duplicate."""
    return runs.select(F.explode("citation_keys").alias("citation_key")).groupBy("citation_key").agg(F.count("*").alias("n_topics"))


def receipts(files: DataFrame) -> DataFrame:
    """One row a receipt folder: receipt_id (the folder's name where the metadata has none), topic, n_cards with a source reference, and `missing`, the files that are absent or unreadable."""
    rows = artifacts(files, RECEIPT_FILES)
    meta, cards = F.col(f"`{RECEIPT_FILES[0]}`"), F.col(f"`{RECEIPT_FILES[3]}`")
    bad = lambda n: F.when(F.try_parse_json(F.col(f"`{n}`")).isNull(), F.lit(n))
    missing = F.filter(F.array(*map(bad, RECEIPT_FILES)), lambda x: x.isNotNull())
    refs = F.filter(F.coalesce(F.from_json(cards, "array<struct<source:struct<ref:string>>>"), F.array().cast("array<struct<source:struct<ref:string>>>")), lambda x: x["source"]["ref"].isNotNull())
    return rows.select(
        F.coalesce(F.get_json_object(meta, "$.submission_id"), F.col("run")).alias("receipt_id"), F.coalesce(F.get_json_object(meta, "$.topic"), F.lit("")).alias("topic"),
        F.size(F.array_distinct(F.transform(refs, lambda x: x["source"]["ref"]))).alias("n_cards"), F.array_join(missing, ", ").alias("missing"),
    )


PACK = "topic string, aliases array<string>, active_arm_synonyms array<string>, placebo_arm_synonyms array<string>, candidate_cap long, cert_floors map<string, double>"


def topic_packs(files: DataFrame) -> DataFrame:
    """(path, pack, problem): files(path, content) of TOML as typed packs, in lists and numbers that PACK declares; `problem` says why a file was rejected.

    A file must parse, and name a topic. Fields that PACK does not declare are left out.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tomllib

        for b in batches:
            texts, problems = [], []
            for content in b.column(1).to_pylist():
                try:
                    texts.append(json.dumps(tomllib.loads(content or ""), default=str))
                    problems.append(None)
                except tomllib.TOMLDecodeError:
                    texts.append(None)
                    problems.append("not TOML")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(problems, pa.string())], ["path", "text", "problem"])

    rows = files.select("path", "content").mapInArrow(parsed, "path string, text string, problem string")
    rows = rows.withColumn("pack", F.from_json("text", PACK))
    unnamed = F.coalesce(F.trim("pack.topic"), F.lit("")) == ""
    return rows.select("path", F.when(F.col("problem").isNull() & ~unnamed, F.col("pack")).alias("pack"), F.coalesce("problem", F.when(unnamed, "no topic")).alias("problem"))
