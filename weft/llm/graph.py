"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b), component its smallest node.

    Each round replaces the edges by shorter ones (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014) and writes them to the shared
    folder. The state never exceeds the edges; a hub is aggregated map side and
    joined under skew splitting, never gathered.
    """
    state = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(state)
    while mark[0]:
        both = state.union(state.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        state = cut(
            small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        )
        before, mark = mark, _mark(state)
        if before == mark:
            break
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _mark(state: DataFrame) -> tuple:
    """Count and order-free hash of the edges, to see when they stop changing."""
    row = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 7))")).first()
    return tuple(row)
