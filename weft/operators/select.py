"""Ordered greedy selection: keep a row unless it conflicts with a kept earlier one.

This is neither a window nor connected components: the keys of a dropped row are
not claimed. The kept set is the lexicographically first maximal independent set
of the conflict graph, found in parallel rounds (Blelloch, Fineman and Shun,
2012): a row is kept once no earlier undecided or kept row conflicts with it, and
dropped once a kept earlier row does. Random orders need few rounds; every round
writes its decisions to the shared folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> None:
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weft-select-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def greedy_by_keys(rows: DataFrame, order: str, keys: str) -> DataFrame:
    """The kept rows of rows(order, keys array): no two share a key.

    A row waits only for the row just before it under each key, and is dropped when
    a kept row holds one of its keys; so no pairs are made, and a key that a third of
    all rows hold makes one link a row.
    """
    return greedy_by_sides(rows, order, rows.select(order, F.explode(F.array_distinct(keys)).alias("key"), F.lit(0).alias("side")))


def greedy_by_sides(rows: DataFrame, order: str, held: DataFrame) -> DataFrame:
    """The kept rows of rows(order) where the same key in held(order, key, side) is a conflict, unless the side is the same and not 0.

    Sides 1 and 2 say that each of some rows conflicts with each of some others, but not
    with its own kind, by one key a row. Keys that nobody contests are left out first.
    """
    held = held.where(F.col(order).isNotNull() & F.col("key").isNotNull())
    on = lambda k: F.col("side") == k
    each = held.groupBy("key").agg(*[F.count_if(on(k)).alias(f"n{k}") for k in range(3)])
    contested = each.where("n0 > 1 or (n0 > 0 and n1 + n2 > 0) or (n1 > 0 and n2 > 0)").select("key")
    open_ = first = cut(held.join(contested, "key", "left_semi"))
    rival = lambda f: F.when(on(1), F.least(f(0), f(2))).when(on(2), F.least(f(0), f(1))).otherwise(F.least(f(0), f(1), f(2)))
    kept = None
    while True:
        # First in line under all of its keys: kept.
        front = open_.groupBy("key").agg(*[F.min(F.when(on(k), F.col(order))).alias(f"f{k}") for k in range(3)])
        ahead = rival(lambda k: F.col(f"f{k}"))
        state = open_.join(front, "key").groupBy(order).agg(F.bool_and(F.coalesce(F.col(order) <= ahead, F.lit(True))).alias("now"))
        won = cut(state.where("now").select(order))
        if won.isEmpty():
            break
        kept = won if kept is None else kept.union(won)
        claimed = open_.join(won, order, "left_semi").groupBy("key").agg(*[F.max(F.when(on(k), True)).alias(f"f{k}") for k in range(3)])
        rest = open_.join(won, order, "left_anti")
        lost = rest.join(claimed, "key").where(rival(lambda k: F.col(f"f{k}")).isNotNull()).select(order).distinct()
        open_ = cut(rest.join(lost, order, "left_anti"))
    out = first.select(order).distinct()
    if kept is not None:
        out = out.join(kept, order, "left_anti")
    return rows.where(F.col(order).isNotNull()).join(out, order, "left_anti")


def greedy_by_edges(rows: DataFrame, order: str, edges: DataFrame) -> DataFrame:
    """The kept rows under conflicts edges(early, late), early < late by `order`."""
    open_ = cut(edges.select("early", "late").distinct())
    dropped = None
    while not open_.isEmpty():
        # Rows with no undecided earlier neighbour are kept; their later neighbours go.
        late = open_.select("late").distinct()
        kept = open_.select("early").distinct().join(late, F.col("early") == F.col("late"), "left_anti")
        out = cut(open_.join(kept, "early", "left_semi").select("late").distinct())
        dropped = out if dropped is None else dropped.union(out)
        gone = out.select(F.col("late").alias("id"))
        settled = kept.select(F.col("early").alias("id"))
        open_ = cut(
            open_.join(gone, F.col("early") == F.col("id"), "left_anti").join(gone, F.col("late") == F.col("id"), "left_anti").join(settled, F.col("early") == F.col("id"), "left_anti")
        )
    if dropped is None:
        return rows
    return rows.join(dropped.select(F.col("late").alias(order)).distinct(), order, "left_anti")
