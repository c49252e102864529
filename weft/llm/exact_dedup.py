"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

One scan takes the length and the prefix hash of every normalised text and
aggregates them. Lengths, then (length, prefix) pairs, that occur once are
finished. The others set slots of a table that grows with their number up to
`slots`, so that it can be broadcast at any input size; a second scan reads full
content and hashes it for rows whose slot is set. A slot that unequal pairs share
costs a hash and no correctness, since the last grouping is by the full hash; far
beyond `slots` pairs most rows are hashed and grouped, at some 70 bytes each.

Text is never shuffled; only ids, sizes and hashes are. A group of any size is
only ever aggregated (map side first) or joined under skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import WS_CHARS, cut

PREFIX_CHARS = 128
#: At most; a row of the table is a long.
SLOTS = 1 << 21


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WS_CHARS, "")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    prefix_chars: int = PREFIX_CHARS,
    slots: int = SLOTS,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the most code points stays, then the
    one with the smallest id (a null id after all others), then any one of rows that
    agree in both. Null and empty texts are equal to each other and to texts of
    white space. text_sha256 is null for rows that refinement finished before the
    full hash, unless `digest_all` asks for every row's digest. An empty table
    gives no rows; other columns of docs are not looked at.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
        normalised(F.col(text_col)).alias("norm"),
    )
    size = F.length("norm").alias("size")
    head = F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("head")

    by_head = cut(rows.select(size, head).groupBy("size", "head").agg(F.count("*").alias("n")))
    by_size = by_head.groupBy("size").agg(F.sum("n").alias("m")).where("m > 1").select("size")
    shared = by_head.where("n > 1").join(by_size, "size", "left_semi")
    slots = min(slots, 1 << max(10, (16 * shared.count()).bit_length()))
    slot = F.pmod(F.xxhash64("size", "head"), F.lit(slots)).alias("slot")
    # At most `slots` rows of one long, whatever the input's size.
    wanted = shared.select(slot).distinct().withColumn("survives", F.lit(True))

    hashed = cut(
        rows.select("id", "points", "norm", size, head)
        .withColumn("slot", slot)
        .join(F.broadcast(wanted), "slot", "left")
        .select(
            "id",
            "points",
            "size",
            "head",
            F.coalesce("survives", F.lit(False)).alias("survives"),
            F.when(F.lit(digest_all) | F.coalesce("survives", F.lit(False)), F.unhex(F.sha2("norm", 256))).alias("digest"),
        )
        .withColumn("row", F.monotonically_increasing_id())
    )
    first = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("row").alias("row")))
    # Cut, so that both sides of the join are plain shuffles, whose hot keys Spark can split.
    groups = cut(hashed.where("survives").groupBy("size", "head", "digest").agg(F.count("*").alias("group_size"), first.alias("first")))
    found = hashed.where("survives").join(groups, ["size", "head", "digest"]).select(
        "id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    alone = hashed.where(~F.col("survives")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
    return found.unionByName(alone).withColumnRenamed("id", id_col)
