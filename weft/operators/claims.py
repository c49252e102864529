"""Numeric claims in sentences, and what they are bound to.

`extract` gives typed claims with offsets from whole texts: each kind's matches with
their places, without those that lie within a claim of an earlier kind. It and `bind`
read texts in Arrow batches (see functions.places).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.places import Joined, inside, nearest
from weft.functions.text import any_of

# One pattern a kind, in order of priority. A later claim that lies within the
# span of an earlier one of a blocking kind is dropped.
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
KINDS = {
    "p_value": r"\b[pP] ?(<=|>=|<|>|=) ?(0?\.[0-9]+)",
    "ci": rf"\b({NUMBER})% CI:? ?\(?(-?{NUMBER}) ?(?:to|-|,) ?(-?{NUMBER})",
    "n": r"\b[nN] ?= ?([0-9]+)",
    "mean_sd": rf"({NUMBER}) ?(?:±|\+/-) ?({NUMBER})",
    "percent": rf"({NUMBER})%",
    "ratio": rf"\b(?:HR|OR|RR) ?[=:]? ?({NUMBER})",
    "unit": rf"({NUMBER}) ?(mg|kg|ml|mmol|years|weeks|days)\b",
}
BLOCKING = ("ci", "mean_sd", "percent", "ratio")
BLOCKED = ("percent", "ratio", "unit")


def found(text: Column, kind: str, group: int = 1) -> Column:
    """All values of one group of a kind's pattern."""
    return F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(group))


def extract(rows: DataFrame, id_col: str, text_col: str, spread: int | None = None, keep: tuple[str, ...] = (), sentence: bool = True) -> DataFrame:
    """(id, kind, start, end, groups, keep..., sentence): claims of every row's text, by place and kind; null has none.

    `spread` deals the texts over so many tasks first, for inputs of a few large files.
    Without `sentence` claims do not carry their text.
    """
    text = F.col(text_col).cast("string")
    texts = rows.select(F.col(id_col).alias("id"), *keep, text.alias("sentence")).where(F.col("sentence").rlike("[0-9]"))
    if spread:
        texts = texts.repartition(spread)
    carried = ["id", *keep, *(["sentence"] if sentence else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, found = _claims(b.column(b.num_columns - 1).to_pylist())
            own = dict(zip(carried, b.select(carried).take(row).columns, strict=True)) | found
            names = ["id", *found, *carried[1:]]
            yield pa.RecordBatch.from_arrays([own[n] for n in names], names)

    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in carried[1:])
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, kind string, start int, end int, groups array<string>" + (f", {fields}" if fields else ""))


def _claims(texts: list[str]) -> tuple[pa.Array, dict[str, pa.Array]]:
    """Rows and columns of the claims of a batch, by row, place and kind."""
    joined = Joined(texts)
    blocking, parts = [], []
    for kind, pattern in KINDS.items():
        s, e, found = joined.matches(pattern)
        if kind in BLOCKED:
            taken = np.zeros(len(s), bool)
            for outer in blocking:
                taken |= inside(s, e, outer)
            free = np.flatnonzero(~taken)
            s, e, found = s[free], e[free], [found[i] for i in free]
        if kind in BLOCKING:
            blocking.append((s, e))
        groups = [m.groups("") for m in found]
        parts.append((s, e, [kind] * len(s), groups))
    s, e = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    kinds, groups = ([x for p in parts for x in p[i]] for i in (2, 3))
    order = np.lexsort((np.repeat([sorted(KINDS).index(k) for k in KINDS], [len(p[0]) for p in parts]), s))
    row = joined.row(s[order])
    base = joined.starts[row] if len(row) else 0
    sizes = np.fromiter((len(groups[i]) for i in order), np.int32, len(order))
    flat = pa.array([x for i in order for x in groups[i]], pa.string())
    return pa.array(row, pa.int64()), {
        "kind": pa.array(kinds, pa.string()).take(pa.array(order)),
        "start": pa.array((s[order] - base).astype(np.int32)), "end": pa.array((e[order] - base).astype(np.int32)),
        "groups": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat),
    }


def bind(claims: DataFrame, endpoints: list[str], arms: list[str], directions: dict[str, str]) -> DataFrame:
    """Adds endpoint, arm, direction and confidence to claims(sentence, start, role, ...).

    Each is the term nearest to the claim, of tied ones the first of its list. All three
    found in an effect claim is high, one at least partial, else none. A sentence that
    several claims of a batch share is read once.
    """
    lists = [[rf"\b{re.escape(t)}\b" for t in terms] for terms in (endpoints, arms, [*directions])]
    columns = claims.columns
    at, said = columns.index("start"), columns.index("sentence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(said).fill_null("").dictionary_encode()
            joined, row = Joined([t.lower() for t in own.dictionary.to_pylist()]), own.indices.to_numpy()
            ranks = [pa.array(nearest(joined, p, row, b.column(at).to_numpy()).astype(np.int32)) for p in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, *ranks], [*columns, "_e", "_a", "_d"])

    fields = ", ".join(f"`{c}` {claims.schema[c].dataType.simpleString()}" for c in columns)
    rows = claims.mapInArrow(run, f"{fields}, _e int, _a int, _d int")
    term = lambda c, terms: F.get(F.array(*map(F.lit, terms)).cast("array<string>"), F.col(c))
    n = sum((F.col(c) >= 0).cast("int") for c in ("_e", "_a", "_d"))
    confidence = F.when((n == 3) & (F.col("role") == "effect"), "high").when(n > 0, "partial").otherwise("none")
    return rows.select(*columns, term("_e", endpoints).alias("endpoint"), term("_a", arms).alias("arm"), term("_d", [*directions.values()]).alias("direction"), confidence.alias("confidence"))


# Words that tell what a sentence is about.
DOSE_WORDS = ("dose", "dosing", "dosage", "administered", "received", "treatment with", "treated with", "/day", "per day", "/d ", "twice daily", "tablets")
DURATION_WORDS = ("follow-up", "follow up", "duration of", "for a period of", "during the", "weeks of", "months of", "years of", "treatment period", "trial duration")
POPULATION_WORDS = ("age range", "aged", "older adults", "participants were", "subjects were", "median age", "mean age", "enrolled", "recruited", "inclusion criteria")
BACKGROUND_WORDS = ("prevalence", "incidence", "worldwide", "globally", "general population", "epidemiology", "background", "literature reports", "previous studies", "estimated to affect", "is associated with the")
EFFECT_WORDS = (
    "increased", "decreased", "increase of", "decrease of", "increases", "decreases", "improved", "improvement", "improvements", "reduced", "reductions", "blunted", "attenuated", "enhanced", "elevated", "lowered", "diminished",
    "suppressed", "inhibited", "declined", "rose", "rose by", "gained", "gains", "no significant differences", "no significant changes", "did not significantly improve", "between-group difference", "lost more", "lost less",
    "gained more", "gained less", "than placebo", "than metformin", "than control", "than the placebo", "than the metformin", "treatment effect", "primary endpoint", "secondary endpoint", "between groups", "between arms",
    "between the groups", "compared to placebo", "vs. placebo", "vs placebo", "treatment arm", "metformin group", "placebo group", "did not improve", "did not change", "did not differ", "resulted in less",
    "lower percentage change", "no effect", "tended to increase", "did not reach", "did not reach significance", "were not statistically significant", "was not statistically significant",
)
MATCHED_GROUPS = r"\bdifferences? in age,? (?:and )?sex\b"
AT_BASELINE = r"^baseline (?:characteristics|scores|values|levels)\b"
AFTER_BASELINE = r"\b(?:after|change[ds]?|follow[- ]up|post[- ]treatment)\b"


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return any_of(text, list(words))


def claim_role(sentence: Column, section: Column) -> Column:
    """background, population, effect, duration, dose or unknown: the first that fits.

    Words of background come before those of an effect; of sections only the introduction decides, where nothing else does.
    """
    s = F.lower(F.coalesce(sentence, F.lit("")))
    return (
        F.when(has_any(s, BACKGROUND_WORDS), "background").when(s.rlike(MATCHED_GROUPS) | (s.rlike(AT_BASELINE) & ~s.rlike(AFTER_BASELINE)), "population").when(has_any(s, EFFECT_WORDS), "effect")
        .when(has_any(s, DURATION_WORDS), "duration").when(has_any(s, DOSE_WORDS), "dose").when(has_any(s, POPULATION_WORDS), "population")
        .when(section == "introduction", "background").otherwise("unknown")
    )


def claim_role_sql(sentence: str, section: str) -> str:
    """claim_role() for DuckDB."""
    s = f"lower(coalesce({sentence}, ''))"
    has = lambda words: "(" + " or ".join(f"contains({s}, '{w}')" for w in words) + ")"
    rules = [
        (has(BACKGROUND_WORDS), "background"), (f"regexp_matches({s}, '{MATCHED_GROUPS}') or (regexp_matches({s}, '{AT_BASELINE}') and not regexp_matches({s}, '{AFTER_BASELINE}'))", "population"),
        (has(EFFECT_WORDS), "effect"), (has(DURATION_WORDS), "duration"), (has(DOSE_WORDS), "dose"), (has(POPULATION_WORDS), "population"), (f"{section} = 'introduction'", "background"),
    ]
    return "case " + " ".join(f"when {when} then '{then}'" for when, then in rules) + " else 'unknown' end"


def sentences(text: Column) -> Column:
    """Pieces that end in a full stop, question or exclamation mark before white space."""
    return F.filter(F.split(text, r"(?<=[.!?])[ \n]+"), lambda s: s != "")


def paper_receipts(claims: DataFrame) -> DataFrame:
    """claims(paper, ord, outcome, endpoint, direction, p) to one receipt a paper.

    The outcome is the most frequent (the first seen on a tie); at most 20 endpoint
    directions and the p-values stay with it.
    """
    counts = claims.groupBy("paper", "outcome").agg(F.count("*").alias("c"), F.min("ord").alias("f"))
    outcome = counts.groupBy("paper").agg(F.max_by("outcome", F.struct("c", -F.col("f"))).alias("outcome"), F.sum("c").alias("n_claims"))
    last = claims.where("endpoint is not null").groupBy("paper", "endpoint").agg(F.max_by("direction", "ord").alias("d"), F.min("ord").alias("o"))
    ends = last.groupBy("paper").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "endpoint", "d"))), 1, 20).alias("e"))
    ps = claims.where("p is not null").groupBy("paper").agg(F.array_sort(F.collect_set("p")).alias("p_values"))
    return (
        outcome.join(ends, "paper", "left").join(ps, "paper", "left")
        .select("paper", "outcome", "n_claims", F.map_from_entries(F.transform("e", lambda x: F.struct(x["endpoint"], x["d"]))).alias("endpoint_directions"), "p_values")
    )
