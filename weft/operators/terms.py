"""Many terms looked for in many texts at once: Aho-Corasick automata inside tasks.

The automaton of all terms is built in each task from a list that is broadcast. Its size
is checked first; beyond `shard_bytes` the terms are dealt over shards by hash, each
with an automaton of its own, and texts are read once a shard. A text costs its length and its hits, however many terms there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of terms in one automaton; in memory it takes some tens of times that.
SHARD_BYTES = 8 << 20


def find_terms(texts: DataFrame, keep: list[str], text_col: str, terms: DataFrame, term_col: str, *, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(keep..., term, at, before, behind): every place where a text holds a term, as characters; overlapping ones too.

    at counts from 0; before and behind are the characters beside it, empty at an end. Null texts and null or empty terms give nothing.
    """
    own = terms.select(F.col(term_col).cast("string").alias("term")).where(F.length("term") > 0).distinct()
    size = own.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    sc = texts.sparkSession.sparkContext
    found = None
    for k in range(shards):
        # About shard_bytes of text, by hash.
        part = sc.broadcast([r[0] for r in own.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == k).collect()])
        hits = _hits(texts.select(*keep, F.col(text_col).alias("_text")), keep, part)
        found = hits if found is None else found.union(hits)
    return found


def _hits(rows: DataFrame, keep: list[str], part: object) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in part.value:
            automaton.add_word(t, t)
        if part.value:
            automaton.make_automaton()
        for b in batches:
            row, term, at, before, behind = [], [], [], [], []
            for i, text in enumerate(b.column(len(keep)).to_pylist() if part.value else []):
                for end, t in automaton.iter(text or ""):
                    begin = end - len(t) + 1
                    row.append(i)
                    term.append(t)
                    at.append(begin)
                    before.append(text[begin - 1] if begin else "")
                    behind.append(text[end + 1 : end + 2])
            kept = b.select(keep).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(term, pa.string()), pa.array(at, pa.int64()), pa.array(before, pa.string()), pa.array(behind, pa.string())], [*keep, "term", "at", "before", "behind"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, term string, at long, before string, behind string")


def is_word(hit: str = "") -> Column:
    """A hit that no letter or digit touches, in lower-cased text."""
    return ~F.col(f"{hit}before").rlike("[a-z0-9]") & ~F.col(f"{hit}behind").rlike("[a-z0-9]")


def topic_mentions(receipts: DataFrame, aliases: DataFrame, least: int = 3) -> DataFrame:
    """(id, topic, mentions) of receipts(id, topic, text) and aliases(topic, alias): a text names its topic by an alias of `least` characters or more, as words.

    A topic without aliases is taken as mentioned.
    """
    low = aliases.select("topic", F.lower(F.trim("alias")).alias("term")).where(F.col("term").isNotNull()).distinct()
    long = low.where(F.length("term") >= least)
    hits = find_terms(receipts.select("id", "topic", F.lower("text").alias("text")), ["id", "topic"], "text", long, "term").where(is_word())
    seen = hits.select("id", "topic", "term").distinct().join(long, ["topic", "term"]).select("id", "topic").distinct().withColumn("hit", F.lit(True))
    known = low.select("topic").distinct().withColumn("named", F.lit(True))
    rows = receipts.select("id", "topic").join(known, "topic", "left").join(seen, ["id", "topic"], "left")
    return rows.select("id", "topic", (F.col("hit").isNotNull() | F.col("named").isNull()).alias("mentions"))


#: Arms of any topic.
COMMON_ARMS = ("placebo", "control", "vehicle", "pooled")


def arm_belongs(claims: DataFrame, arms: DataFrame) -> DataFrame:
    """(id, topic, belongs) of claims(id, topic, arm) and arms(topic, arm): the arm holds one of the topic's, or is held by one.

    A claim without an arm and a topic without arms belong.
    """
    own = arms.select("topic", F.lower(F.trim("arm")).alias("term")).where(F.length("term") > 0).distinct()
    topics = own.select("topic").distinct()
    own = own.union(topics.select("topic", F.explode(F.array(*map(F.lit, COMMON_ARMS))))).distinct()
    rows = claims.select("id", "topic", F.lower(F.trim(F.coalesce("arm", F.lit("")))).alias("said"))
    said = rows.select("said").where(F.length("said") > 0).distinct()
    holds = find_terms(said, ["said"], "said", own, "term").select("said", "term")
    held = find_terms(own.select("term").distinct().withColumnRenamed("term", "whole"), ["whole"], "whole", said, "said").select(F.col("term").alias("said"), F.col("whole").alias("term"))
    fits = rows.join(holds.union(held).distinct(), "said").join(own, ["topic", "term"], "left_semi").select("id", "topic", "said").distinct().withColumn("fits", F.lit(True))
    met = rows.join(topics.withColumn("known", F.lit(True)), "topic", "left").join(fits, ["id", "topic", "said"], "left")
    return met.select("id", "topic", (F.col("known").isNull() | (F.col("said") == "") | F.col("fits").isNotNull()).alias("belongs"))
