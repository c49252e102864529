"""Many sources under one cap, and search terms that widen while too little is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quotas(available: DataFrame, cap: int) -> DataFrame:
    """(topic, source, n, quota) of available(topic, source, n): what each source may give so that a topic takes `cap` at most.

    All sources get the same, and what one does not use goes to the others, until none
    can use more: the fixed point is a level, found at once from the sources in order of
    what they have. Of sources above the level the first by name get the odd ones. A
    topic has a row for each source, no more.
    """
    by = W.partitionBy("topic")
    order = by.orderBy("n", "source")
    rows = available.withColumn("i", F.row_number().over(order)).withColumn("k", F.count("*").over(by)).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("rest", F.lit(cap) - F.col("before")).withColumn("r", F.col("k") - F.col("i") + 1)
    # The first source that has more than its share of the rest sets the level for itself and all after it.
    over = F.col("n") * F.col("r") > F.col("rest")
    first = F.min(F.when(over, F.struct("i", "rest", "r"))).over(by)
    rows = rows.withColumn("first", first)
    above = F.col("first").isNotNull() & (F.col("i") >= F.col("first.i"))
    rows = rows.withColumn("above", above).withColumn("name", F.row_number().over(W.partitionBy("topic", "above").orderBy("source")))
    level = F.floor(F.col("first.rest") / F.col("first.r"))
    odd = (F.col("name") <= F.pmod(F.col("first.rest"), F.col("first.r"))).cast("long")
    return rows.select("topic", "source", "n", F.when(above, level + odd).otherwise(F.col("n")).cast("long").alias("quota"))


def fan_in(hits: DataFrame, per_source: int, cap: int) -> DataFrame:
    """hits(topic, source, rank, ...) that a source's limit and its quota let through; rank counts from 1 within a topic's source, so nothing is sorted."""
    within = hits.where(F.col("rank") <= per_source)
    q = quotas(within.groupBy("topic", "source").agg(F.count("*").alias("n")), cap)
    return within.join(q.select("topic", "source", "quota"), ["topic", "source"]).where(F.col("rank") <= F.col("quota")).select(*hits.columns)


def fan_in_stats(hits: DataFrame, taken: DataFrame, status: DataFrame, cap: int) -> DataFrame:
    """(topic, source, raw, taken, status, capped) of every source asked, status(topic, source, status): a source that failed or found nothing has its row too."""
    count = lambda d, n: d.groupBy("topic", "source").agg(F.count("*").alias(n))
    rows = status.select("topic", "source", "status").join(count(hits, "raw"), ["topic", "source"], "left").join(count(taken, "taken"), ["topic", "source"], "left").fillna(0, ["raw", "taken"])
    return rows.withColumn("capped", F.sum("raw").over(W.partitionBy("topic")) > cap)


def widened(packs: DataFrame, precursors: dict[str, list[str]], general: list[str], floor: int = 60, max_rounds: int = 3) -> DataFrame:
    """(topic, terms, rounds, status, reason) of packs(topic, name, terms, status, candidate_cap, counts): what widening the search came to.

    counts are the candidates that each round found. A round ends the search if the pack
    is stopped, its cap or the floor is reached, or no new term is left; else it adds the
    precursors of what the pack speaks of and the general terms, without those it has in
    any case. max_rounds bounds the rounds.
    """

    def new_terms(terms: Column) -> Column:
        spoken = F.lower(F.concat_ws(" ", F.col("name"), F.array_join(terms, " ")))
        found = [F.when(F.contains(spoken, F.lit(m)), F.array(*map(F.lit, x))).otherwise(F.array().cast("array<string>")) for m, x in precursors.items()]
        all_ = F.concat(*found, F.array(*map(F.lit, general)).cast("array<string>"))
        have = F.transform(terms, F.lower)
        return F.array_distinct(F.filter(all_, lambda t: ~F.array_contains(have, F.lower(t))))

    def step(s: Column, n: Column) -> Column:
        new = new_terms(s["terms"])
        said = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
        end = (
            F.when(F.col("status") == "stop", said("stop", "pack is stopped")).when(n >= F.col("candidate_cap"), said("stop", "candidate cap reached"))
            .when(n >= floor, said("enough", "candidate floor met")).when(F.size(new) == 0, said("stop", "no new expansion terms"))
        )
        grown = F.struct(F.concat(s["terms"], new).alias("terms"), (s["rounds"] + 1).alias("rounds"), F.lit("expand").alias("status"), F.lit("candidate floor not met").alias("reason"), F.lit(False).alias("done"))
        ended = F.struct(s["terms"].alias("terms"), s["rounds"].alias("rounds"), end["a"].alias("status"), end["b"].alias("reason"), F.lit(True).alias("done"))
        return F.when(s["done"], s).when(end.isNotNull(), ended).otherwise(grown)

    begin = F.struct(F.col("terms"), F.lit(0).alias("rounds"), F.lit("stop").alias("status"), F.lit("no retrieval counts supplied").alias("reason"), F.lit(False).alias("done"))
    s = packs.select("topic", F.aggregate(F.slice("counts", 1, max_rounds), begin, step).alias("s"))
    full = ~F.col("s.done") & (F.col("s.rounds") == max_rounds)
    return s.select("topic", "s.terms", "s.rounds", F.when(full, "stop").otherwise(F.col("s.status")).alias("status"), F.when(full, "max rounds reached").otherwise(F.col("s.reason")).alias("reason"))
