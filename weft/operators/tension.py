"""Tensions between receipts: pairs, severities and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.text import endpoint_key
from weft.operators.classify import lookup
from weft.operators.select import cut, greedy_by_edges, greedy_by_keys
from weft.operators.similarity import close_pairs

# Severities and weights that rankings depend on.
SEVERITY = {"orthogonal": 0, "agreement": 2, "indirectness_gap": 3, "mechanism_vs_clinical": 3, "null_vs_positive": 4, "null_vs_negative": 4, "disagreement": 5}
TIER_POINTS = {"A": 3.0, "B": 2.0, "C": 1.0}
DIRECT_POINTS = {"direct": 2.0, "indirect": 1.0, "mechanistic": 0.5}


def directional_kind(a: Column, b: Column) -> Column:
    """Of two directions on one endpoint."""
    pair = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    signed = a.isin("positive", "negative") & b.isin("positive", "negative")
    return F.when(pair("positive", "negative"), "disagreement").when(pair("null", "positive"), "null_vs_positive").when(pair("null", "negative"), "null_vs_negative").when(signed & (a == b), "agreement").otherwise("orthogonal")


def endpoint_map(directions: Column, endpoints: Column, aggregate: Column) -> Column:
    """Map from endpoint key to direction: the stated ones, or the aggregate's if there is one endpoint alone.

    directions is an array of (endpoint, direction); of one endpoint's the last counts.
    """
    known = ("positive", "negative", "null", "mixed", "unclear")
    said = F.transform(F.coalesce(directions, F.array().cast("array<struct<endpoint:string,direction:string>>")), lambda d: F.struct(endpoint_key(F.coalesce(d["endpoint"], F.lit(""))).alias("k"), F.lower(F.trim(F.coalesce(d["direction"], F.lit("")))).alias("v")))
    good = F.filter(said, lambda d: (d["k"] != "") & d["v"].isin(*known))
    keys = F.array_distinct(F.transform(good, lambda d: d["k"]))
    own = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(good, lambda d: d["k"] == k), -1)["v"])))
    names = F.filter(F.array_distinct(F.transform(F.coalesce(endpoints, F.array().cast("array<string>")), lambda e: endpoint_key(F.coalesce(e, F.lit(""))))), lambda e: e != "")
    whole = F.lower(F.trim(F.coalesce(aggregate, F.lit(""))))
    single = (F.size(names) == 1) & whole.isin(*known)
    return F.when(F.size(good) > 0, own).when(single, F.map_from_arrays(names, F.array(whole))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def shared_endpoint(a: Column, b: Column) -> Column:
    """struct(order, endpoint, kind): of the endpoints of two maps the severest comparison, the first by name on a tie; null if none is comparable."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    each = F.transform(shared, lambda e: F.struct(e.alias("endpoint"), directional_kind(F.element_at(a, e), F.element_at(b, e)).alias("kind")))
    ranked = F.transform(F.filter(each, lambda x: x["kind"] != "orthogonal"), lambda x: F.struct((-lookup(SEVERITY, x["kind"])).alias("order"), x["endpoint"].alias("endpoint"), x["kind"].alias("kind")))
    return F.array_min(ranked)


def _kind(a: str, b: str, shared: Column) -> Column:
    """Kind of a pair of rows: outcomes and directness before directions, which only direct receipts on one outcome compare."""
    one, two = F.col(f"{a}.directness") == "direct", F.col(f"{b}.directness") == "direct"
    same = F.col(f"{a}.outcome") == F.col(f"{b}.outcome")
    return (
        F.when(~same, F.when(one != two, "mechanism_vs_clinical").otherwise("orthogonal"))
        .when(one != two, "indirectness_gap").when(one & two, F.coalesce(shared, F.lit("orthogonal"))).otherwise("orthogonal")
    )


#: Receipts that pairs() puts into a chunk, about; and cells, each way, over which the chunks of a block meet.
CHUNK, CELLS = 256, 16


def pairs(receipts: DataFrame, block: str, chunk: int = CHUNK) -> DataFrame:
    """(block, a, b, kind, severity, endpoint) of receipts(id, outcome, directness, endpoint_directions) that share a block.

    The pairs are the result, so there are as many as receipts squared; severity() counts
    them. Receipts alike in outcome, directness and directions (a map, see endpoint_map)
    are compared once with others: they lie in chunks of bounded size, pairs of chunks are
    dealt over cells, and ids are paired where two chunks meet, without a shuffle.
    """
    key = F.to_json(F.array_sort(F.map_entries("endpoint_directions")))
    kinds = ["_block", "outcome", "directness", "key"]
    rows = receipts.select(F.col(block).alias("_block"), "id", "outcome", "directness", "endpoint_directions", key.alias("key")).where("_block is not null and id is not null")
    sized = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in kinds]).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_chunks"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in kinds]
    numbered = rows.join(sized, same).withColumn("_n", F.pmod(F.xxhash64("id"), F.col("_chunks")))
    alike = numbered.groupBy(*kinds, "_n").agg(F.collect_list("id").alias("ids"), F.first("endpoint_directions").alias("endpoint_directions"))
    parts = cut(alike.withColumn("p", F.monotonically_increasing_id())).withColumn("cell", F.pmod(F.xxhash64("p"), F.lit(CELLS)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))
    dealt = 8 * receipts.sparkSession.sparkContext.defaultParallelism
    a = parts.select("*", F.col("cell").alias("i"), every.alias("j")).repartition(dealt, "_block", "i", "j").alias("a")
    b = parts.select("*", F.col("cell").alias("j"), every.alias("i")).repartition(dealt, "_block", "i", "j").alias("b")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("_block", "i", "j")] + [F.col("a.p") <= F.col("b.p")])
    met = met.withColumn("_s", shared_endpoint(F.col("a.endpoint_directions"), F.col("b.endpoint_directions")))
    kind = _kind("a", "b", F.col("_s.kind"))
    met = met.select(F.col("a._block").alias(block), (F.col("a.p") == F.col("b.p")).alias("_own"), F.col("a.ids").alias("_x"), F.col("b.ids").alias("_y"), kind.alias("kind"), F.when(kind == F.col("_s.kind"), F.col("_s.endpoint")).alias("endpoint"))
    met = met.withColumn("severity", lookup(SEVERITY, F.col("kind")))
    each = met.withColumn("_x", F.explode("_x")).withColumn("_y", F.explode("_y")).where((F.col("_x") < F.col("_y")) | (~F.col("_own") & (F.col("_x") > F.col("_y"))))
    return each.select(block, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "kind", "endpoint", "severity")


def severity(receipts: DataFrame, block: str) -> DataFrame:
    """(block, kind, n, severity): how many pairs of each kind a block has, without making them.

    Receipts alike in outcome, directness and directions are one row with a count;
    pairs within it and between such rows are counted by products.
    """
    key = F.to_json(F.array_sort(F.map_entries("endpoint_directions")))
    rows = receipts.withColumn("directness", F.when(F.col("directness") == "direct", "direct").otherwise("other"))
    alike = cut(rows.groupBy(block, "outcome", "directness", key.alias("key")).agg(F.count("*").alias("n"), F.first("endpoint_directions").alias("endpoint_directions")))
    a, b = alike.alias("a"), alike.alias("b")
    place = lambda x: F.struct(f"{x}.outcome", f"{x}.directness", f"{x}.key")
    met = a.join(b, (F.col(f"a.{block}") == F.col(f"b.{block}")) & (place("a") <= place("b")))
    n = F.when(place("a") == place("b"), F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n"))
    kind = _kind("a", "b", shared_endpoint(F.col("a.endpoint_directions"), F.col("b.endpoint_directions"))["kind"])
    out = met.select(F.col(f"a.{block}").alias(block), kind.alias("kind"), n.cast("long").alias("n")).groupBy(block, "kind").agg(F.sum("n").alias("n")).where("n > 0")
    return out.withColumn("severity", lookup(SEVERITY, F.col("kind")))


def weight(tier: Column, directness: Column) -> Column:
    return lookup(TIER_POINTS, F.substring(tier, 1, 1), 0.0) + lookup(DIRECT_POINTS, directness, 0.0)


def contenders(receipts: DataFrame, block: str, top: int) -> DataFrame:
    """The receipts that `top` tensions of a block can be made of: of those alike in outcome, directness and directions the 2 * top + 2 with the smallest ids.

    Choices by severity and then by ids use 2 * top receipts at most, so one of the smaller
    ids of its kind is free in place of any other.
    """
    key = F.to_json(F.array_sort(F.map_entries("endpoint_directions")))
    w = W.partitionBy(block, "outcome", "directness", key).orderBy("id")
    return receipts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 2 * top + 2).drop("_k")


def top_capped(receipts: DataFrame, block: str, top: int) -> DataFrame:
    """(block, a, b, kind, endpoint, severity) of the first `top` tensions by severity, the highest first, and ids, each receipt in one at most.

    Receipts alike in outcome, directness and directions are one row with the smallest of
    their ids (see contenders), and two such rows meet once. Of their pairs the first is that
    of their smallest free ids; so a choice is a minimum over rows that meet, and
    takes out two ids. Pairs of receipts are never made.
    """
    key = F.to_json(F.array_sort(F.map_entries("endpoint_directions")))
    same = [block, "outcome", "directness", "key"]
    few = contenders(receipts, block, top).withColumn("key", key)
    kinds = cut(few.groupBy(*same).agg(F.array_sort(F.collect_list("id")).alias("ids"), F.any_value("endpoint_directions").alias("endpoint_directions")))
    a, b = kinds.alias("a"), kinds.alias("b")
    place = lambda x: F.struct(*[f"{x}.{c}" for c in same[1:]])
    met = a.join(b, F.col(f"a.{block}").eqNullSafe(F.col(f"b.{block}")) & (F.coalesce(place("a") <= place("b"), F.lit(False))))
    met = met.withColumn("_s", shared_endpoint(F.col("a.endpoint_directions"), F.col("b.endpoint_directions")))
    kind = _kind("a", "b", F.col("_s.kind"))
    rows = met.select(F.col(f"a.{block}").alias(block), (place("a") == place("b")).alias("alike"), F.col("a.ids").alias("x"), F.col("b.ids").alias("y"), kind.alias("kind"), F.when(kind == F.col("_s.kind"), F.col("_s.endpoint")).alias("endpoint"))
    rows = cut(rows.withColumn("severity", lookup(SEVERITY, F.col("kind"))))
    used: list = []
    chosen: list = []
    id_type = receipts.schema["id"].dataType
    while len(chosen) < top:
        gone = F.array(*[F.lit(i).cast(id_type) for i in used]).cast(f"array<{id_type.simpleString()}>")
        free = lambda c: F.filter(c, lambda i: ~F.array_contains(gone, i))
        at = rows.withColumns({"x": free("x"), "y": free("y")})
        one, two = F.get("x", F.lit(0)), F.when(F.col("alike"), F.get("x", F.lit(1))).otherwise(F.get("y", F.lit(0)))
        pairs = at.withColumns({"a": F.least(one, two), "b": F.greatest(one, two)}).where(one.isNotNull() & two.isNotNull())
        first = pairs.agg(F.min(F.struct((-F.col("severity")).alias("order"), "a", "b", block, "kind", "endpoint", "severity")).alias("f")).first()["f"]
        if first is None:
            break
        used += [first["a"], first["b"]]
        chosen.append(tuple(first[c] for c in (block, "a", "b", "kind", "endpoint", "severity")))
    types = {c: rows.schema[c].dataType.simpleString() for c in (block, "kind", "endpoint", "severity")}
    kept = f"{block} {types[block]}, a {id_type.simpleString()}, b {id_type.simpleString()}, kind {types['kind']}, endpoint {types['endpoint']}, severity {types['severity']}"
    return receipts.sparkSession.createDataFrame(chosen, kept)


def top_tensions(tensions: DataFrame, order: str, top: int) -> DataFrame:
    """The first `top` of tensions(order, a, b) by order, each paper in one at most."""
    kept = greedy_by_keys(tensions.withColumn("_papers", F.array("a", "b")), order, "_papers")
    return kept.drop("_papers").orderBy(order).limit(top)


def plan(tensions: DataFrame, order: str) -> DataFrame:
    """Adds tension_id, T001 on, by order within a short list of selected tensions."""
    return tensions.withColumn("tension_id", F.format_string("T%03d", F.row_number().over(W.orderBy(order))))


def diverse(vectors: DataFrame, group: str, order: str, vector: str, limit: float = 0.86) -> DataFrame:
    """Greedy choice per group, by order: a row whose cosine with a chosen one exceeds limit is skipped.

    Rows that are too close are found by blocked matrix products, and the choice among
    them is made in rounds (see select), so that a group of any size is never gathered.
    """
    named = vectors.select(group, order, vector)
    near = close_pairs(named, group, order, vector, limit)
    key = lambda g, o: F.struct(g.alias("g"), o.alias("o"))
    edges = near.select(key(F.col("g"), F.col("early")).alias("early"), key(F.col("g"), F.col("late")).alias("late"))
    rows = named.select(key(F.col(group), F.col(order)).alias("_key"))
    return greedy_by_edges(rows, "_key", edges).select(F.col("_key.g").alias(group), F.col("_key.o").alias(order))
