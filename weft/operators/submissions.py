"""Markers of submissions, and the publication state of ledgers' child rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_markers(markers: Column) -> Column:
    """The submission markers of a row, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(markers, F.array().cast("array<string>")), lambda m: m.startswith("submission:"))))


def ledger_markers(ledgers: DataFrame, children: DataFrame) -> DataFrame:
    """(ledger, marker): submission ids of ledgers(ledger, submission_ids)' own responses as markers, and those of children(ledger, markers)."""
    own = ledgers.select("ledger", F.explode("submission_ids").alias("id")).where(F.coalesce(F.trim("id"), F.lit("")) != "").select("ledger", F.concat(F.lit("submission:"), F.trim("id")).alias("marker"))
    return own.union(children.select("ledger", F.explode(row_markers(F.col("markers"))))).distinct()


def synced_children(rows: DataFrame, runs: DataFrame, markers: DataFrame, submitted: DataFrame | None = None) -> DataFrame:
    """rows(ledger, kind, run, markers, submitted, published, row) with the two flags set anew, and `changed`.

    A child is matched by its run among runs(ledger, run) or by one of its markers among
    markers(marker), and is then submitted and published; one that is not matched is no
    longer published. With submitted(run), the first reconciliation: an attempt is matched
    if it has no run, if its run is among runs, or, for a ledger without matched runs, if
    its run was submitted; what is not matched stays as it is.
    """
    by_run = runs.select("ledger", "run").distinct().withColumn("_run", F.lit(True))
    marked = rows.select("row", F.explode(row_markers(F.col("markers"))).alias("marker")).join(markers.select("marker").distinct(), "marker", "left_semi").select("row").distinct().withColumn("_mark", F.lit(True))
    met = rows.join(by_run, ["ledger", "run"], "left").join(marked, "row", "left")
    match = F.col("_run").isNotNull() | F.col("_mark").isNotNull()
    drop = ~match
    if submitted is not None:
        known = runs.select("ledger").distinct().withColumn("_known", F.lit(True))
        sent = submitted.select("run").distinct().withColumn("_sent", F.lit(True))
        met = met.join(known, "ledger", "left").join(sent, "run", "left")
        first = (F.coalesce("run", F.lit("")) == "") | F.col("_run").isNotNull() | (F.col("_known").isNull() & F.col("_sent").isNotNull())
        match, drop = F.when(F.col("kind") == "attempts", first).otherwise(match), F.lit(False)
    now = {"submitted": F.when(match, 1).otherwise(F.col("submitted")), "published": F.when(match, 1).when(drop, 0).otherwise(F.col("published"))}
    changed = (now["submitted"] != F.col("submitted")) | (now["published"] != F.col("published"))
    return met.select("row", "ledger", "kind", "run", now["submitted"].alias("submitted"), now["published"].alias("published"), changed.alias("changed"))


def child_counts(rows: DataFrame) -> DataFrame:
    """(ledger, submitted, published): how many of a ledger's submissions are either."""
    own = rows.where(F.col("kind") == "submissions")
    return own.groupBy("ledger").agg(F.count_if(F.col("submitted") != 0).alias("submitted"), F.count_if(F.col("published") != 0).alias("published"))


def settled(rows: DataFrame, ttl: str, until: Column) -> DataFrame:
    """(marker, run, submitted_at, published_at, status) of rows(marker, kind, run, ts): what streaming.markers makes of them once its watermark is at `until`.

    A submission is published by the first publication of its marker that lies at most `ttl`
    from it, and expired when it has none and `until` is past that; one that waits has no row.
    """
    # The first publication from `ttl` before a submission on, by one sorted pass over a marker's rows.
    span = F.expr(f"interval {ttl}")
    sent = F.col("kind") == "submission"
    placed = rows.where(F.col("kind").isin("submission", "publication")).select("marker", "run", "ts", sent.alias("sent"), F.when(sent, F.col("ts") - span).otherwise(F.col("ts")).alias("at"))
    ahead = W.partitionBy("marker").orderBy("at", F.col("sent").desc()).rowsBetween(0, W.unboundedFollowing)
    met = placed.withColumn("p", F.first(F.when(~F.col("sent"), F.col("ts")), ignorenulls=True).over(ahead)).where("sent")
    near = F.when(F.col("p") <= F.col("ts") + span, F.col("p"))
    status = F.when(near.isNotNull(), "published").when(F.col("ts") + span <= until, "expired")
    return met.select("marker", "run", F.col("ts").alias("submitted_at"), near.alias("published_at"), status.alias("status")).where("status is not null")
