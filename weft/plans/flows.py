"""Whole flows: landed payloads to a corpus, claims to a verdict, runs to a field.

A flow gives named DataFrames; nothing runs until one of them is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.text import dedupe_key, identity_keys
from weft.operators import aggregates, claims, classify, identity, meta, studies, tension, verdicts
from weft.sources import landed


def seed_corpus(payloads: DataFrame, pack: dict, current_year: int) -> dict[str, DataFrame]:
    """payloads(source, payload, ord) to hits, records, classified records, funnel and quarantine.

    pack has aliases and excluded lists and a lexicon; see classify.corpus_class().
    """
    hits = landed.read_all(payloads).withColumn("ord", F.monotonically_increasing_id())
    keyed = hits.withColumn("key", dedupe_key(F.col("doi"), F.col("pmid"), F.col("nct"), F.col("title")))
    merged = identity.merge_hits(keyed)
    ids = keyed.groupBy("key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("doi", "pmid", "nct", "venue")])
    records = merged.join(ids, "key")
    owned = records.withColumn("keys", identity_keys(F.col("doi"), F.col("pmid"), F.col("nct"), F.col("abstract"), F.col("title")))
    kept = identity.dedup_records(owned, "ord", "keys").drop("keys")
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    role = studies.study_role(F.lit(""), F.col("title"), F.col("abstract"), F.lit(False))
    design = studies.study_design(role, F.col("abstract"))
    rows = (
        kept.withColumn("class", classify.corpus_class(text, F.lower(F.coalesce("title", F.lit(""))), pack["aliases"], pack["lexicon"], pack.get("excluded", [])))
        .withColumn("role", role).withColumn("design", design).withColumn("tier", studies.evidence_tier(role, design, F.col("venue")))
    )
    rows = rows.withColumn("pool", classify.extraction_pool(F.col("class"), F.col("tier"))).withColumn("score", classify.paper_score(F.col("class"), F.col("tier"), F.lit(None).cast("string"), F.col("year"), current_year))
    return {"hits": hits, "records": records, "corpus": rows, "funnel": classify.funnel(rows), "quarantine": landed.quarantine(payloads)}


def synthesize(papers: DataFrame, endpoints: list[str], arms: list[str], directions: dict[str, str]) -> dict[str, DataFrame]:
    """papers(paper, topic, outcome, directness, text) to claims, receipts, tensions and one verdict a topic."""
    found = claims.extract(papers, "paper", "text").withColumnRenamed("id", "paper").withColumn("role", claims.claim_role(F.col("sentence"), F.lit("results")))
    bound = claims.bind(found, endpoints, arms, directions)
    usable = bound.where("confidence <> 'none'").join(papers.select("paper", "topic", "outcome", "directness"), "paper")
    p = F.when(F.col("kind") == "p_value", F.get("groups", F.lit(1)).cast("double"))
    comparator = F.when(F.col("kind") == "p_value", F.get("groups", F.lit(0)))
    sign = F.when(F.col("direction") == "positive", 1).when(F.col("direction") == "negative", -1).otherwise(0)
    signed = usable.withColumn("sign", sign).withColumn("sig", F.when(p.isNotNull(), aggregates.significant(comparator, p)))
    direction = aggregates.effect_direction(signed, ["paper"])
    receipts = usable.groupBy("paper", "topic", "outcome", "directness").agg(F.count("*").alias("n_claims"), F.count_if(F.col("confidence") == "high").alias("n_high")).join(direction, "paper").withColumnRenamed("paper", "id")
    receipts = receipts.withColumn("endpoint_directions", F.map_from_arrays(F.array(F.col("outcome").cast("string")), F.array("direction")))
    pairs = tension.pairs(receipts, "topic")
    counts = receipts.groupBy("topic").agg(F.count("*").alias("receipts"), F.sum("n_high").alias("claims"), F.count_if(F.col("directness") == "direct").alias("direct"))
    tensions = pairs.where("kind <> 'orthogonal'").groupBy("topic").agg(F.count("*").alias("tensions"))
    runs = counts.join(tensions, "topic", "left").fillna({"tensions": 0})
    none = F.lit(0)
    level = verdicts.maturity(F.col("receipts"), F.col("claims"), F.col("tensions"), F.lit(""), none, none, none, F.lit(False))
    return {"claims": bound, "receipts": receipts, "tensions": pairs, "runs": runs.withColumn("level", level)}


def synthesize_field(runs: DataFrame, effects: DataFrame) -> dict[str, DataFrame]:
    """runs(topic, run, level, receipts) and effects(topic, outcome, sign) to a field's tables.

    The best run of each topic counts; topics at level 0 are left out.
    """
    best = identity.best_run(runs.where("level > 0"), "topic", "run", [F.col("level"), F.col("receipts"), F.col("run")])
    own = effects.join(best.select("topic"), "topic", "left_semi")
    return {"manifest": best, "contradictions": aggregates.contradictions(own), "convergences": aggregates.convergences(own.select("topic", F.col("outcome").alias("mechanism")))}


def pooled_outcomes(raw: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """Effects of any shape to pools, with what was left out and why.

    raw has the columns of meta.SHAPES, metric, study and ord; a study's first usable
    row in a group counts.
    """
    made = meta.normalize_effects(raw)
    good = made.where("error is null").withColumn("_k", F.row_number().over(W.partitionBy(*by, "metric_out", "study").orderBy("ord"))).where("_k = 1").drop("_k")
    rows = good.select(*by, F.col("metric_out").alias("pool_metric"), "study", F.col("effect_size").alias("effect"), F.col("effect_se").alias("se"))
    groups = [*by, "pool_metric"]
    return {"pools": meta.pool(rows, groups), "fixed": meta.pool(rows, groups, model="fixed"), "left_out": meta.unpoolable(rows.withColumn("metric", F.col("pool_metric")), groups), "quarantine": made.where("error is not null")}
