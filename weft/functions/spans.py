"""Places of pattern matches as column expressions, and the same in DuckDB SQL.

A match is marked before and behind by two control characters, and the text is cut at
the first of them; what each piece holds gives the places. Texts with those characters
lose them beforehand, so places are those of the text without them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, BEHIND = "\x01", "\x02"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a pattern's matches in order; from 0, end beyond the last character. Null text has none.

    The pattern may have groups; its matches are not empty.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), BEFORE + BEHIND, "")
    parts = F.split(F.regexp_replace(plain, f"({pattern})", f"{BEFORE}$1{BEHIND}"), BEFORE)
    found = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("match"))

    def step(state: Column, part: Column) -> Column:
        size = F.instr(part, BEHIND) - 1
        one = F.struct(state["at"].alias("start"), (state["at"] + size).alias("end"), F.substr(part, F.lit(1), size).alias("match"))
        # The piece before the first match has no mark behind.
        grown = F.when(size > 0, F.array_append(state["found"], one)).otherwise(state["found"])
        return F.struct((state["at"] + F.length(part) - 1).alias("at"), grown.alias("found"))

    # Pieces are named once only: a second mention would match the pattern again.
    return F.aggregate(parts, F.struct(F.lit(1).alias("at"), F.slice(F.array(found), 1, 0).alias("found")), step, lambda s: s["found"])


def distance(span: Column, anchor: Column) -> Column:
    """Characters between a span and an anchor, 0 within."""
    return F.greatest(span["start"] - anchor, anchor - span["end"], F.lit(0))


def nearest(places: list[Column], anchor: Column) -> Column:
    """The rank of the list of places that has the one nearest to the anchor, the first of tied ones; null if there is none."""

    def ranked(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(distance(s, anchor).alias("d"), F.lit(k).alias("k")))

    return F.array_min(F.concat(*[ranked(k, p) for k, p in enumerate(places)]))["k"]


def located_sql(text: str, pattern: str) -> str:
    """located() for DuckDB."""
    quoted = pattern.replace("'", "''")
    cut = f"string_split(regexp_replace({text}, '({quoted})', chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    start = "cast(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(replace(x, chr(2), '')))), 0) as int)"
    one = f"{{'start': {start}, 'end': {start} + instr(p[i], chr(2)) - 1, 'match': substr(p[i], 1, instr(p[i], chr(2)) - 1)}}"
    return f"list_transform([{cut}], lambda p: list_transform(range(2, len(p) + 1), lambda i: {one}))[1]"


def nearest_sql(places: list[str], anchor: str) -> str:
    """nearest() for DuckDB."""
    ranked = [f"list_transform({p}, lambda s: {{'d': greatest(s.start - {anchor}, {anchor} - s.\"end\", 0), 'k': {k}}})" for k, p in enumerate(places)]
    joined = ranked[0]
    for r in ranked[1:]:
        joined = f"list_concat({joined}, {r})"
    return f"list_min({joined}).k"
