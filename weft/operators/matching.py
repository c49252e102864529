"""Joins of claims, sources, frameworks and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.text import normalize_doi, tokens
from weft.operators.terms import find_terms


def once(rows: DataFrame) -> DataFrame:
    """The distinct rows, dealt over the session's cores: they are small in bytes, and Spark would give them to one task, however much is read in each."""
    return rows.distinct().repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def without_retracted(rows: DataFrame, doi: str, lists: list[DataFrame]) -> DataFrame:
    """rows whose DOI is in none of the lists(doi); rows without a DOI stay, unverified.

    No list at all is an error: nothing must pass because a service was away.
    """
    if not lists:
        raise ValueError("no retraction list")
    bad = lists[0].select("doi")
    for other in lists[1:]:
        bad = bad.unionByName(other.select("doi"))
    bad = bad.select(normalize_doi(F.col("doi")).alias("_d")).where("_d is not null").distinct()
    own = rows.withColumn("_k", normalize_doi(F.col(doi)))
    return own.join(bad, F.col("_k") == F.col("_d"), "left_anti").withColumn("verified", F.col("_k").isNotNull()).drop("_k")


def contract_mismatches(rows: DataFrame, frozen: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, now, then) where a row and its frozen copy differ, or one is missing."""
    text = lambda a, f: F.col(f"{a}.{f}").cast("string")
    j = rows.alias("a").join(frozen.alias("b"), key, "full").select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text("a", f).alias("now"), text("b", f).alias("then")) for f in fields])).alias("x"))
    return j.select(key, "x.*").where(~F.col("now").eqNullSafe(F.col("then")))


def containing(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame, term_col: str) -> DataFrame:
    """(id, term): texts that hold a term somewhere. The empty term is in no text."""
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return find_terms(rows, ["id"], "text", terms, term_col).select("id", "term").distinct()


def framework_engagement(frameworks: DataFrame, receipts: DataFrame) -> DataFrame:
    """(framework, status, matched) of frameworks(framework, anchor) against receipts(id, mechanism, sign, primary).

    A framework whose anchors match a positive primary receipt and any other is
    extended; else supported or challenged by the sign of what matches, or
    insufficient.
    """
    found = containing(receipts.select(F.col("mechanism").alias("id"), "mechanism").distinct(), "id", "mechanism", frameworks, "anchor")
    hits = frameworks.join(found, F.col("anchor") == F.col("term")).select("framework", F.col("id").alias("_m")).distinct()
    m = hits.join(receipts, F.col("_m") == F.col("mechanism")).select("framework", "id", "sign", "primary").distinct()
    g = m.groupBy("framework").agg(F.count_if((F.col("sign") > 0) & F.col("primary")).alias("pp"), F.count_if(~((F.col("sign") > 0) & F.col("primary"))).alias("other"), F.count_if(F.col("sign") > 0).alias("up"), F.count_if(F.col("sign") < 0).alias("down"), F.count("*").alias("matched"))
    status = F.when((F.col("pp") > 0) & (F.col("other") > 0), "extends").when(F.col("up") > F.col("down"), "supports").when(F.col("down") > 0, "challenges").otherwise("insufficient")
    named = frameworks.select("framework").distinct().join(g, "framework", "left")
    return named.select("framework", F.when(F.col("matched").isNull(), "insufficient").otherwise(status).alias("status"), F.coalesce("matched", F.lit(0)).alias("matched"))


def expand_mechanisms(topics: DataFrame, mapping: DataFrame) -> DataFrame:
    """(topic, mechanism) of topics(topic, domain): mapped by topic or by domain, each once.

    Rows that repeat are dropped before they meet, not only after.
    """
    topics, mapping = topics.select("topic", "domain").distinct(), mapping.select("key", "mechanism").distinct()
    by_topic = topics.join(mapping, topics.topic == mapping.key).select("topic", "mechanism")
    return by_topic.union(topics.join(mapping, topics.domain == mapping.key).select("topic", "mechanism")).distinct()


def rare_tokens(packs: DataFrame, name: str, text: Column, most: int) -> DataFrame:
    """(name, tokens): each pack's tokens that at most `most` packs have."""
    t = packs.select(name, F.explode(F.array_distinct(tokens(text))).alias("w"))
    few = t.groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    return t.join(few, "w").groupBy(name).agg(F.array_sort(F.collect_list("w")).alias("tokens"))


def topic_fits(texts: DataFrame, id_col: str, text: Column, topics: DataFrame, topic: str, name: Column, least: float = 0.75) -> DataFrame:
    """(id, topic) of texts that share two words with a topic's name, or three quarters of its words.

    Words are joined, so a topic costs the texts that have a word of it.
    """
    words = topics.select(F.col(topic).alias("topic"), F.array_distinct(tokens(name)).alias("k"))
    keys = words.select("topic", F.size("k").alias("size"), F.explode("k").alias("w"))
    own = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(text))).alias("w"))
    shared = own.join(keys, "w").groupBy("id", "topic").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return shared.where((F.col("n") >= 2) | (F.col("n") >= least * F.col("size"))).select("id", "topic")


def unseen_topics(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def quantities(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0))


def align(claims: DataFrame, passages: DataFrame, on: str, least: int = 3) -> DataFrame:
    """(claim, passage, overlap) of claims(claim, on, text) and passages(passage, on, text) under one citation.

    They share `least` words of four letters or more, and the passage has every
    quantity of the claim. A citation has few of either.
    """
    words = lambda c: F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) >= 4))
    a = claims.select(on, "claim", words(F.col("text")).alias("cw"), quantities(F.col("text")).alias("cq"))
    b = passages.select(on, "passage", words(F.col("text")).alias("pw"), quantities(F.col("text")).alias("pq"))
    j = a.join(b, on).withColumn("overlap", F.size(F.array_intersect("cw", "pw")))
    return j.where((F.col("overlap") >= least) & (F.size(F.array_except("cq", "pq")) == 0)).select("claim", "passage", "overlap")


def trace_status(claims: DataFrame, aligned: DataFrame, by: str) -> DataFrame:
    """(by, claims, aligned, passed): four fifths of the claims, rounded up, are aligned."""
    rows = claims.join(aligned.select("claim").distinct().withColumn("hit", F.lit(1)), "claim", "left")
    g = rows.groupBy(by).agg(F.count("*").alias("claims"), F.count("hit").alias("aligned"))
    return g.withColumn("passed", F.col("aligned") >= F.floor((F.col("claims") * 4 + 4) / 5))


def best_span(aligned: DataFrame) -> DataFrame:
    """(claim, passage): the passage with most overlap, the first on a tie."""
    return aligned.groupBy("claim").agg(F.max_by("passage", F.struct("overlap", -F.col("passage"))).alias("passage"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("left").alias("side")).union(b.join(a, key, "left_anti").select(key, F.lit("right").alias("side")))


def capped_per_group(rows: DataFrame, caps: list[tuple[list[str], int]], order: list[Column]) -> DataFrame:
    """Rows within the first n of each of several groupings, one after the other."""
    for by, n in caps:
        rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
    return rows


def soft_filter(rows: DataFrame, keep: Column) -> DataFrame:
    """Rows that fit, or all rows if none does: one row of counts decides."""
    flag = rows.agg(F.coalesce(F.bool_or(keep), F.lit(False)).alias("_any"))
    return rows.join(F.broadcast(flag)).where(~F.col("_any") | keep).drop("_any")


def nearest_before(events: DataFrame, marks: DataFrame, by: str, ts: str) -> DataFrame:
    """Each event with the latest mark(by, ts, value) not after it: an as-of join.

    Events and marks are one sorted stream per key, so no pairs are made.
    """
    both = events.select(by, ts, "event_id", F.lit(None).cast("string").alias("_v"), F.lit(1).alias("_o")).union(marks.select(by, ts, F.lit(None).cast("long"), "value", F.lit(0)))
    w = W.partitionBy(by).orderBy(ts, "_o").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("value", F.last("_v", ignorenulls=True).over(w)).where("_o = 1").select("event_id", by, "value")
