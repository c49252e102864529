"""Audits of texts against a corpus, and provenance digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import canonical_number

NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"


def numbers(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number): the distinct numbers of each text, in canonical form."""
    return rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(NUMBER), 0))).alias("raw")).select("id", canonical_number(F.col("raw")).alias("number")).distinct()


def traceability(prose: DataFrame, pool: DataFrame) -> DataFrame:
    """(id, numbers, traced, coverage) of prose(id, number) against pool(number)."""
    known = pool.select("number").distinct().withColumn("hit", F.lit(1))
    rows = prose.join(known, "number", "left").groupBy("id").agg(F.count("*").alias("numbers"), F.count("hit").alias("traced"))
    return rows.withColumn("coverage", F.round(F.col("traced") / F.col("numbers"), 6))


def denylist_hits(rows: DataFrame, id_col: str, text_col: str, phrases: dict[str, str]) -> DataFrame:
    """(id, line, phrase, level): lines, from 1, that hold a phrase in any case."""
    lines = rows.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.lower(text_col), "\n")).alias("line", "text"))
    terms = F.filter(F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(v).alias("level")) for p, v in phrases.items()]), lambda s: F.contains(F.col("text"), s["phrase"]))
    return lines.select("id", (F.col("line") + 1).alias("line"), F.explode(terms).alias("h")).select("id", "line", "h.phrase", "h.level")


def repeated_words(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, repeats): words that follow themselves, in any case.

    Counted over each text's word array, not by a backreference.
    """
    w = F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), 0)
    arr = rows.select(F.col(id_col).alias("id"), w.alias("w"))
    same = F.aggregate("w", F.struct(F.lit("").alias("last"), F.lit(0).alias("n")), lambda s, x: F.struct(x.alias("last"), (s["n"] + (x == s["last"]).cast("int")).alias("n")))
    return arr.select("id", same["n"].alias("repeats"))


def fingerprint(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., n, digest): the same for the same rows in any order.

    Two sums of row hashes, so that no group is gathered or sorted. Fields end with a
    unit separator; a missing one is a record separator.
    """
    fields = [p for c in columns for p in (F.coalesce(F.col(c).cast("string"), F.lit("\x1e")), F.lit("\x1f"))]
    h = F.md5(F.concat(*fields))
    part = lambda at: F.conv(F.substring("_h", at, 15), 16, 10).cast("long")
    rows = rows.withColumn("_h", h).groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(part(1)).alias("x"), F.sum(F.pmod(part(18), F.lit(1_000_003))).alias("s"))
    return rows.select(*by, "n", F.sha2(F.concat_ws("|", "n", "x", "s"), 256).alias("digest"))


def identity_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds sha256 over fields joined by a unit separator; missing fields count as empty."""
    return rows.withColumn("identity_sha256", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256))


def label_mismatch(cited: DataFrame, listed: DataFrame) -> DataFrame:
    """(label, problem): cited(label) without reference, listed(label) never cited."""
    a, b = cited.select("label").distinct(), listed.select("label").distinct()
    return a.join(b, "label", "left_anti").select("label", F.lit("unreferenced").alias("problem")).union(b.join(a, "label", "left_anti").select("label", F.lit("orphan").alias("problem")))
