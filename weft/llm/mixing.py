"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the expected number of copies of each of
its documents. The whole part is given to all; the fractional parts are rounded
dependently. A pair of documents exchanges mass, up for one and down for the
other in inverse proportion to their sizes, by the random one of two steps that
keeps every expectation, until one of them is whole. So the words taken from a
source never move away from its target until its last document is rounded.

Pairs are made along a tree. Documents of a source are dealt to leaves of about
`FANOUT` rows by a hash; each leaf passes on the one residual that it cannot
pair, `FANOUT` leaves share a parent, and so on up to the source's root. A source
of any size is a number of small groups at each level. Randomness comes from
hashes of ids and sizes, so reruns agree. Where more rows than a leaf should hold
agree in source, id and size, each is dealt by its own number: the draws of such
rows repeat if the table is read in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import cut, unit_hash, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
FANOUT = 32
SEED = 11
_NEAR = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn. A target
    above `cap` times its source's size stops there and the excess is shared again
    by weight, round by round. Ranks come from range partitions and their counts,
    the rounds from aggregates, so no step gathers the sources.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("last", F.col("source").isNull())
        .repartitionByRange(parts, "last", "source")
        .withColumn("part", F.spark_partition_id())
    )
    # One row per partition.
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    )
    place = F.coalesce("before", F.lit(0)) + F.row_number().over(W.partitionBy("part").orderBy("last", "source")) - 1
    ladder = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut(
        dealt.join(F.broadcast(before.select("part", "before")), "part")
        .withColumn("weight", F.element_at(ladder, (place % len(weights) + 1).cast("int")))
        .select("source", "source_size", "weight", (F.col("source_size") * F.lit(cap)).alias("top"))
    )
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, full = 0.0, None
    while True:
        # Sources that the last rate fills stay full; the rest share what is left.
        filled = F.col("top") <= F.col("weight") * F.lit(rate) if full is not None else F.lit(False)
        row = ranked.agg(
            F.sum(F.when(filled, F.col("top")).otherwise(0.0)), F.sum(F.when(filled, 0.0).otherwise(F.col("weight"))), F.sum(filled.cast("int"))
        ).first()
        if row[2] == full or not row[1]:
            break
        full, rate = row[2], (total - row[0]) / row[1]
    return ranked.select("source", "source_size", F.least("top", F.col("weight") * F.lit(rate)).alias("target"))


def _fold(items: Column) -> Column:
    """Pairs the items of one node in order: (residual or null, rounded items)."""

    def whole(x: Column) -> Column:
        return (x < _NEAR) | (x > 1 - _NEAR)

    def step(state: Column, b: Column) -> Column:
        a = state["left"]
        up = F.least((1 - a["x"]) * a["size"], b["x"] * b["size"])
        down = F.least(a["x"] * a["size"], (1 - b["x"]) * b["size"])
        first = unit_hash(a["id"], b["id"], a["size"], b["size"], F.lit(SEED)) * (up + down) < down
        move = F.when(first, up).otherwise(-down)
        a2 = a.withField("x", a["x"] + move / a["size"])
        b2 = b.withField("x", b["x"] - move / b["size"])
        done = F.filter(F.array(a2, b2), lambda i: whole(i["x"]))
        rest = F.filter(F.array(a2, b2), lambda i: ~whole(i["x"]))
        paired = F.struct(F.get(rest, F.lit(0)).alias("left"), F.concat(state["done"], done).alias("done"))
        return F.when(a.isNull(), F.struct(b.alias("left"), state["done"].alias("done"))).otherwise(paired)

    empty = F.struct(F.get(F.slice(items, 1, 0), F.lit(0)).alias("left"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(items, empty, step)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, copies, taken.

    size counts words `[^\\x20\\x09-\\x0D]+` of the whole text (null: 0); copies is
    the times that the mix repeats the document, taken = copies * size. Documents
    without words take the whole part of their expectation. Null is a source of its
    own. Rows that repeat an id are separate documents. An empty table gives no
    rows.
    """
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row")))
    targets = source_targets(sized, weights, share, cap).withColumnRenamed("source", "of")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(F.col("wanted") + _NEAR)
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("wanted", wanted)
    item = F.struct("id", "size", "source", "source_size", "target", base.alias("base"), F.greatest(F.col("wanted") - base, F.lit(0.0)).alias("x"))
    items = rows.select(item.alias("i"), "row")
    loose = (F.col("i.size") > 0) & (F.col("i.x") > _NEAR)
    done = items.where(~loose).select(F.col("i").withField("x", F.lit(0.0)).alias("i"))

    open_ = cut(items.where(loose).withColumn("like", F.xxhash64("i.source", "i.id", "i.size")))
    crowded = open_.groupBy("like").agg(F.count("*").alias("n")).where(F.col("n") > fanout).select(F.col("like").alias("many"))
    leaves = open_.groupBy("i.source").agg(F.ceil(F.count("*") / fanout).alias("leaves")).withColumnRenamed("source", "of")
    widest = leaves.agg(F.max("leaves")).first()[0] or 0
    own = F.when(F.col("many").isNotNull(), F.col("row"))
    level = open_.join(crowded, F.col("like") == F.col("many"), "left").join(leaves, F.col("i.source").eqNullSafe(F.col("of"))).select(
        "i", F.pmod(F.xxhash64("i.id", "i.size", F.lit(SEED + 1), own), F.col("leaves")).alias("node")
    )
    order = F.struct(F.xxhash64("i.id", "i.size", F.lit(SEED + 2)).alias("h"), F.col("i.id").alias("id"), F.col("i").alias("i"))
    while widest:
        folded = cut(
            level.groupBy(F.col("i.source").alias("source"), "node")
            .agg(F.array_sort(F.collect_list(order)).alias("all"))
            .select("node", _fold(F.transform("all", lambda o: o["i"])).alias("f"))
        )
        done = done.union(folded.select(F.explode("f.done").alias("i")))
        rest = folded.where("f.left is not null").select(F.col("f.left").alias("i"), F.floor(F.col("node") / fanout).alias("node"))
        if widest == 1:
            # One residual at most for each source.
            last = (unit_hash("i.id", "i.size", F.lit(SEED + 3)) < F.col("i.x")).cast("double")
            done = done.union(rest.select(F.col("i").withField("x", last).alias("i")))
        level, widest = rest, widest // fanout + (widest % fanout > 0) if widest > 1 else 0
    copies = (F.col("i.base") + F.round("i.x").cast("long")).alias("copies")
    return done.select("i.id", "i.size", "i.source", "i.source_size", "i.target", copies).select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
