"""The contract of a revision: what was asked, whether the asks and their context are the same, and what is still unmet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a saved row may say.
DIRECTIONS = ("positive", "negative", "mixed", "null", "unclear")
DIRECTNESS = ("direct", "indirect", "review", "mechanistic", "protocol")
TIERS = ("A1", "A2", "B1", "B2", "B", "C1", "C2", "C", "D1", "mixed")
CLASS = r"^[a-z][a-z0-9_]*$"


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII as an escape, in halves beyond the basic plane."""
    unit = lambda code: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        high, low = F.floor((code - 0x10000) / 0x400) + 0xD800, F.pmod(code - 0x10000, F.lit(0x400)) + 0xDC00
        return F.when(code < 128, c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), escaped), "")).otherwise(text)


def ask_fingerprint(asks: Column) -> Column:
    """SHA-256 of the asks as a compact ASCII JSON list."""
    return F.sha2(ascii_json(F.to_json(asks)), 256)


def feedback(request: Column) -> Column:
    """What a request struct(required_revisions, feedback, retry_unchanged) asks: its required revisions, else its feedback; empty for no request."""
    asked = F.filter(F.transform(F.coalesce(request["required_revisions"], F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.when(request.isNull(), "").when(F.size(asked) > 0, F.array_join(asked, "; ")).otherwise(F.coalesce(request["feedback"], F.lit("")))


def needs_coverage(request: Column) -> Column:
    """There is feedback, no request, or a request that is no plain retry."""
    return (F.trim(feedback(request)) != "") | request.isNull() | ~F.coalesce(request["retry_unchanged"], F.lit(False))


def gate_report(rows: DataFrame) -> DataFrame:
    """rows with `report`, struct(passed, ask_count, unmet_asks); null where an earlier gate cannot be refreshed.

    rows have request, asks, has_paper, unmet (asks that are not met now), context (its
    fingerprint now) and previous(passed, ask_count, unmet_asks, ask_fingerprint,
    context_fingerprint). The earlier gate must be of these asks and this context, and
    agree with itself. What it left unmet stays unmet.
    """
    p = F.col("previous")
    same = (
        (F.size("asks") > 0) & (p["ask_count"] == F.size("asks")) & p["unmet_asks"].isNotNull() & (p["passed"] == (F.size(p["unmet_asks"]) == 0))
        & (F.size(F.array_except(p["unmet_asks"], "asks")) == 0) & (p["ask_fingerprint"] == ask_fingerprint(F.col("asks"))) & (p["context_fingerprint"] == F.col("context"))
    )
    unmet = F.filter("asks", lambda a: F.array_contains("unmet", a) | F.array_contains(p["unmet_asks"], a))
    report = F.struct((F.size(unmet) == 0).alias("passed"), F.size("asks").alias("ask_count"), unmet.alias("unmet_asks"))
    asked = F.col("has_paper") & (F.trim(feedback(F.col("request"))) != "")
    return rows.withColumn("report", F.when(asked & F.coalesce(same, F.lit(False)), report))


def sources_intact(receipts: DataFrame, by: str) -> DataFrame:
    """(by, intact): every receipt of receipts(by, receipt_id, direction, directness, tier, outcome) has an id of its own and says what a saved row may say."""
    valid = F.coalesce(F.col("direction").isin(*DIRECTIONS) & F.col("directness").isin(*DIRECTNESS) & F.col("tier").isin(*TIERS) & F.col("outcome").rlike(CLASS), F.lit(False))
    named = F.coalesce(F.col("receipt_id"), F.lit("")) != ""
    return receipts.groupBy(by).agg((F.bool_and(valid & named) & (F.countDistinct("receipt_id") == F.count("*"))).alias("intact"))
