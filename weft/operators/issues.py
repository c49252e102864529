"""Checks of manuscripts as one table of issues.

A rule is a code, a severity and a Column that holds where something is wrong.
Rules of one level (run, document, paragraph, sentence or line) are evaluated in
one pass over that level's rows; their results are one table (id, code, severity,
place, detail), so that more rules cost no more scans.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = dict[str, tuple[str, Column]]


def issues(rows: DataFrame, id_col: str, place: Column, detail: Column, rules: Rules) -> DataFrame:
    """(id, code, severity, place, detail) of all rules that hold; an unknown rule does not."""
    found = F.array(*[F.when(c, F.struct(F.lit(k).alias("code"), F.lit(s).alias("severity"))) for k, (s, c) in rules.items()])
    kept = F.filter(found, lambda x: x.isNotNull())
    # A filter on the array would be pushed down with all rules in it; one on what it is exploded to is not.
    # The array is made before it is exploded: in a projection what rules share is computed once.
    each = rows.select(F.col(id_col).alias("id"), place.cast("int").alias("place"), F.substring(detail, 1, 120).alias("detail"), kept.alias("ks"))
    each = each.select("id", "place", "detail", F.explode_outer("ks").alias("k"))
    return each.where("k is not null").select("id", "k.code", "k.severity", "place", "detail")


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, line, before, after): lines from 1 with their neighbours, kept in their document's array."""
    arr = docs.select(F.col(id_col), F.split(text_col, "\n").alias("a"))
    rows = arr.select(id_col, "a", F.posexplode("a").alias("i", "line"))
    return rows.select(id_col, (F.col("i") + 1).alias("n"), "line", F.when(F.col("i") > 0, F.get("a", F.col("i") - 1)).alias("before"), F.get("a", F.col("i") + 1).alias("after"))


def line_rules() -> Rules:
    x, after = F.col("line"), F.col("after")
    heading = x.rlike(r"^#{1,6} ")
    table = x.rlike(r"^\s*\|.*\|\s*$")
    cells = F.size(F.split(x, r"\|"))
    return {
        "malformed_header": ("P1", x.rlike(r"^#{1,6} +#{1,6} ")),
        "empty_heading": ("P2", heading & (after.isNull() | after.rlike("^#{1,6} "))),
        "blank_table_row": ("P2", table & x.rlike(r"^[\s|]*$")),
        "malformed_table_row": ("P2", table & after.rlike(r"^\s*\|.*\|\s*$") & (cells != F.size(F.split(after, r"\|")))),
        "unterminated_paragraph": ("P2", ~heading & ~table & (F.length(x) > 60) & ~F.trim(x).rlike(r"[.!?:;)\]]$")),
        "orphan_citation": ("P1", x.rlike(r"^_Cited: ") & (F.coalesce(F.trim("before"), F.lit("")).rlike(r"^(#|$)"))),
        "shouting": ("P2", (F.length(x) > 20) & (x == F.upper(x)) & x.rlike("[A-Z]")),
        "menu_line": ("P2", (F.size(F.regexp_extract_all(x, F.lit(r" \| "), 0)) >= 5) & ~table),
    }


def sentence_rules(current_year: int, significance: float = 0.05) -> Rules:
    """Rules of a sentence column `s`. A pattern runs where the words are that it cannot do without."""
    s, low = F.col("s"), F.lower("s")
    p = F.regexp_extract(low, r"p ?= ?(0?\.[0-9]+)", 1)
    value = F.when(p != "", p.cast("double"))
    has = lambda x, *words: reduce(or_, [F.contains(x, F.lit(w)) for w in words])
    year = F.regexp_extract(s, r"\b[A-Z][a-z]+ et al\.?,? \(?(2[0-9]{3})", 1)
    limit = lambda k: F.regexp_extract(low, r"([0-9]+\.?[0-9]*) (?:falls |is |was )?(below|above) ([0-9]+\.?[0-9]*)", k)
    left, right = F.when(limit(1) != "", limit(1).cast("double")), F.when(limit(3) != "", limit(3).cast("double"))
    return {
        "significance_wording": ("P1", F.contains(low, F.lit("not significant")) & (value < significance)),
        "significance_overclaim": ("P1", F.contains(low, F.lit("significant")) & ~F.contains(low, F.lit("not significant")) & (value >= significance)),
        "future_citation": ("P1", has(s, " et al") & (F.when(year != "", year.cast("int")) > current_year)),
        "arithmetic": ("P1", has(low, "below", "above") & (((limit(2) == "below") & (left > right)) | ((limit(2) == "above") & (left < right)))),
        "no_change_nonzero": ("P1", has(low, "no change") & low.rlike(r"no change[^.]*\([^)]*[1-9]")),
        "double_punctuation": ("P2", s.rlike(r"[,;:]{2}|\.\.(?!\.)|!!|\?\?")),
        "template_artifact": ("P1", has(low, "(potentially)", "(possibly)", "(tbd)", "lorem ipsum", "[citation needed]")),
        "repeated_word": ("P2", low.rlike(r"\b([a-z]+) \1\b")),
        "internal_label": ("P1", has(s, "1_", "2_") & s.rlike(r"\b[ABCD][12]_[a-z]+")),
    }


def document_rules(sections: tuple[str, ...], least_words: int) -> Rules:
    """Rules of columns `text` and `n_words`."""
    x = F.col("text")
    rules: Rules = {
        "thin": ("P2", F.col("n_words") < least_words),
        "duplicate_references": ("P1", F.size(F.regexp_extract_all(x, F.lit(r"(?m)^## References"), 0)) > 1),
    }
    return rules | {f"missing_{s}": ("P2", ~x.rlike(rf"(?im)^#+ *{s}")) for s in sections}


def run_rules(level: Column, stated: Column, counted: Column, unresolved: Column) -> Rules:
    """Rules of a run's row: what its paper states against what was counted."""
    return {
        "count_mismatch": ("P1", stated != counted),
        "unresolved_review": ("P1", unresolved > 0),
        "verdict_despite_failures": ("P1", (level >= 5) & (unresolved > 0)),
        "unknown_state": ("P1", level.isNull() | counted.isNull()),
    }


def summary(found: DataFrame) -> DataFrame:
    """(id, p1, p2, codes): blockers and warnings of each document."""
    sev = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy("id").agg(sev("P1").alias("p1"), sev("P2").alias("p2"), F.array_sort(F.collect_set("code")).alias("codes"))


def rendered_tables(receipts: DataFrame, by: str, order: str, cells: list[str], top: int) -> DataFrame:
    """(by, n, row): Markdown table rows of each group's first `top` receipts."""
    from pyspark.sql import Window as W

    w = W.partitionBy(by).orderBy(order)
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cells]), F.lit(" |"))
    return receipts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).select(by, "n", text.alias("row"))


def direction_mismatches(prose: DataFrame, receipts: DataFrame) -> DataFrame:
    """(outcome, stated, coded) of prose(outcome, stated) that differ from the receipts' dominant direction."""
    from weft.operators.aggregates import direction_profile

    coded = direction_profile(receipts, "outcome", "direction").select("outcome", F.col("dominant").alias("coded"))
    return prose.join(coded, "outcome").where(F.col("stated") != F.col("coded")).select("outcome", "stated", "coded")
