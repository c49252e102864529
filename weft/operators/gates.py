"""Comparisons, appraisals and roll-ups of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def compare_runs(before: DataFrame, after: DataFrame, key: str, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """(key, dimension, old, new, passed): rules give lower, higher or floor, with a tolerance or bound."""
    stack = lambda d, n: d.unpivot([key], list(rules), "dimension", n)
    cast = lambda d: d.select(key, *[F.col(c).cast("double").alias(c) for c in rules])
    rows = stack(cast(before), "old").join(stack(cast(after), "new"), [key, "dimension"], "full")
    passed = F.lit(None).cast("boolean")
    for c, (rule, x) in rules.items():
        ok = {"lower": F.col("new") <= F.col("old") + x, "higher": F.col("new") >= F.col("old") - x, "floor": F.col("new") >= x}[rule]
        passed = F.when(F.col("dimension") == c, ok).otherwise(passed)
    return rows.withColumn("passed", F.coalesce(passed, F.lit(False)))


def worst_domain(rows: DataFrame, study: str, rating: str, scale: list[str]) -> DataFrame:
    """(study, overall): the worst of a study's domain ratings on a scale from best to worst."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(scale) for x in (s, i)])
    return rows.groupBy(study).agg(F.max(F.coalesce(F.try_element_at(order, F.col(rating)), F.lit(len(scale) - 1))).alias("_w")).select(study, F.element_at(F.array(*map(F.lit, scale)), F.col("_w") + 1).alias("overall"))


def grade_certainty(start: Column, down: Column, up: Column) -> Column:
    """Start less downgrades plus upgrades, clamped to 1..4, as a word."""
    level = F.greatest(F.lit(1), F.least(F.lit(4), start - down + up))
    return F.element_at(F.array(*map(F.lit, ("very low", "low", "moderate", "high"))), level.cast("int"))


def rollup(tree: DataFrame, leaves: DataFrame, levels: int) -> DataFrame:
    """Scores of all nodes of tree(id, parent, depth, strategy, critical), from leaves(id, score).

    A parent has the mean or the minimum of its children; 0 if a critical child fails;
    null children are skipped. One aggregate a level, deepest first, to six places.
    """
    known = leaves.select("id", F.col("score").cast("double"))
    for depth in range(levels - 1, -1, -1):
        kids = tree.where(F.col("depth") == depth + 1).join(known, "id").where("score is not null")
        made = kids.groupBy(F.col("parent").alias("id")).agg(F.avg("score").alias("m"), F.min("score").alias("w"), F.bool_or(F.col("critical") & (F.col("score") <= 0)).alias("dead"))
        here = made.join(tree.where(F.col("depth") == depth).select("id", "strategy"), "id")
        known = known.unionByName(here.select("id", F.round(F.when(F.col("dead"), 0.0).when(F.col("strategy") == "min", F.col("w")).otherwise(F.col("m")), 6).alias("score")))
    return known.withColumn("status", F.when(F.col("score") >= 0.8, "passed").when(F.col("score") <= 0, "failed").otherwise("partial"))


def first_assessment(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each group, whole."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(order))).where("_k = 1").drop("_k")


def violations(facts: DataFrame, items: DataFrame, key: str, kind: str, role: str, pairs: dict[str, str]) -> DataFrame:
    """(key, problem): facts without an item, and facts whose kind needs another role."""
    orphan = facts.join(items, key, "left_anti").select(key, F.lit("no item").alias("problem"))
    need = F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), F.col(kind))
    wrong = facts.join(items, key).where(need.isNotNull() & (need != F.col(role))).select(key, F.lit("role mismatch").alias("problem"))
    return orphan.union(wrong)


def admission_mismatch(included: DataFrame, receipts: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """(key, problem): admitted ids without a receipt, receipts not admitted, ids both in and out."""
    a, b, c = (d.select(key).distinct() for d in (included, receipts, excluded))
    label = lambda d, s: d.select(key, F.lit(s).alias("problem"))
    return label(a.exceptAll(b), "no receipt").union(label(b.exceptAll(a), "not admitted")).union(label(a.intersect(c), "both"))
