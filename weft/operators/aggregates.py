"""Roll-ups of claims and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.text import missing


def mode(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by..., value, n): each group's most frequent value; of tied ones the first seen."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("_first"))).alias(value), F.max("n").alias("n"))


def direction_profile(rows: DataFrame, outcome: str, direction: str) -> DataFrame:
    """(outcome, n, dominant): the most frequent direction, mixed if two lead."""
    counts = rows.groupBy(outcome, direction).agg(F.count("*").alias("c"))
    top = counts.groupBy(outcome).agg(F.sum("c").alias("n"), F.max("c").alias("best"))
    led = counts.join(top, outcome).where("c = best").groupBy(outcome, "n").agg(F.count("*").alias("leaders"), F.min(direction).alias("one"))
    return led.select(outcome, "n", F.when(F.col("leaders") > 1, "mixed").otherwise(F.col("one")).alias("dominant"))


def histogram(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) for several fields in one pass; missing counts as unknown."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(missing(F.col(f).cast("string")), F.lit("unknown")).alias("value")) for f in fields]))
    return rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def significant(comparator: Column, p: Column, alpha: float = 0.05) -> Column:
    """< and <= compare with <=; = with <; anything else, or p outside 0..1, is not significant."""
    ok = (p >= 0) & (p <= 1)
    return F.coalesce(F.when(ok & comparator.isin("<", "<="), p <= alpha).when(ok & (comparator == "="), p < alpha), F.lit(False))


def effect_direction(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., direction) of rows(by..., sign, sig): signs of significant rows decide.

    positive and negative together are mixed; none significant is null if any row has
    a p-value, else unclear.
    """
    agg = rows.groupBy(*by).agg(
        F.bool_or(F.col("sig") & (F.col("sign") > 0)).alias("up"), F.bool_or(F.col("sig") & (F.col("sign") < 0)).alias("down"), F.bool_or(F.col("sig").isNotNull()).alias("tested")
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    up, down = yes(F.col("up")), yes(F.col("down"))
    return agg.select(*by, F.when(up & down, "mixed").when(up, "positive").when(down, "negative").when(yes(F.col("tested")), "null").otherwise("unclear").alias("direction"))


def weighted_profile(rows: DataFrame, by: list[str], weight: Column, clinical: Column) -> DataFrame:
    """Weight in all, of clinical rows and of the rest, to four places."""
    return rows.groupBy(*by).agg(
        F.round(F.sum(weight), 4).alias("total"), F.round(F.sum(F.when(clinical, weight).otherwise(0.0)), 4).alias("clinical"), F.round(F.sum(F.when(clinical, 0.0).otherwise(weight)), 4).alias("mechanistic"), F.count("*").alias("n")
    )


def admission_funnel(rows: DataFrame, reason: Column, examples: int = 8) -> DataFrame:
    """(reason, n, examples): rows(id, ...) by reason, with the smallest ids of each.

    Examples come from a ranking that keeps `examples` rows a partition first.
    """
    named = rows.select("id", reason.alias("reason"))
    counts = named.groupBy("reason").agg(F.count("*").alias("n"))
    top = named.withColumn("_k", F.row_number().over(W.partitionBy("reason").orderBy("id"))).where(F.col("_k") <= examples)
    return counts.join(top.groupBy("reason").agg(F.array_sort(F.collect_list("id")).alias("examples")), "reason")


def unique_trials(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct trials; receipts without one count by the first 120 characters of their thesis."""
    sign = F.substring(F.trim(F.regexp_replace(F.lower("thesis"), r"\s+", " ")), 1, 120)
    key = F.coalesce(F.upper(missing(F.col("trial"))), F.concat(F.lit("untrialed:"), sign))
    return rows.groupBy(*by).agg(F.countDistinct(key).alias("trials"))


def hedge_threshold(claims: DataFrame) -> DataFrame:
    """(papers, unclean_share, threshold): 6 if more than half of the papers have more than
    half of their confident claims unclean, else 4."""
    papers = claims.where(F.col("confidence") == "high").groupBy("paper").agg(F.avg(F.col("unclean").cast("int")).alias("r"))
    row = papers.agg(F.count("*").alias("papers"), F.round(F.coalesce(F.avg((F.col("r") > 0.5).cast("int")), F.lit(0.0)), 6).alias("unclean_share"))
    return row.withColumn("threshold", F.when(F.col("unclean_share") > 0.5, 6).otherwise(4))


def contradictions(rows: DataFrame) -> DataFrame:
    """(outcome, positive_topics, negative_topics) of rows(topic, outcome, sign): outcomes on
    which some topics are mostly positive and others mostly negative."""
    n = rows.groupBy("topic", "outcome").agg(F.count_if(F.col("sign") > 0).alias("p"), F.count_if(F.col("sign") < 0).alias("m"))
    side = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("topic"))))
    out = n.groupBy("outcome").agg(side(F.col("p") > F.col("m")).alias("positive_topics"), side(F.col("m") > F.col("p")).alias("negative_topics"))
    return out.where((F.size("positive_topics") > 0) & (F.size("negative_topics") > 0))


def convergences(rows: DataFrame, min_topics: int = 2) -> DataFrame:
    """(mechanism, topics) of rows(topic, mechanism) that at least min_topics topics share."""
    return rows.groupBy("mechanism").agg(F.array_sort(F.collect_set("topic")).alias("topics")).where(F.size("topics") >= min_topics)
