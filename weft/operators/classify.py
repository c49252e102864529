"""Deterministic classifiers of records: decision lists over text and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import any_of, hits

# Scores and bonuses that results depend on.
CLASS_SCORE = {"core_on_thesis": 100, "background_mechanism": 60, "adjacent_clinical": 40, "off_thesis": 20, "reject": 0}
TIER_BONUS = {"A1": 30, "A2": 25, "B1": 15, "B2": 10, "C1": 5, "C2": 3, "C": 5}
DIRECTNESS_BONUS = {"direct": 20, "review": 15, "indirect": 10, "mechanistic": 5}
KEEP = ("core_on_thesis", "background_mechanism", "adjacent_clinical")
PRIMARY_TIERS = ("A1", "A2", "B1")
TIER_WEIGHT = {"A1": 1.0, "A2": 0.7, "B1": 0.6, "B": 0.5, "B2": 0.4, "C1": 0.3, "C": 0.25, "C2": 0.2, "D1": 0.1}
DEFAULT_WEIGHT = 0.2


def lookup(values: dict, key: Column, default: object = None) -> Column:
    table = F.create_map(*[F.lit(x) for p in values.items() for x in p])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def alias_hit(text: Column, aliases: list[str]) -> Column:
    """An alias, or its plural, between characters that are not letters or digits."""
    found = F.lit(False)
    for a in aliases:
        found = found | text.rlike(f"(^|[^a-z0-9]){a}s?([^a-z0-9]|$)")
    return found


def corpus_class(text: Column, title: Column, aliases: list[str], lexicon: dict[str, list[str]], excluded: list[str] = ()) -> Column:
    """One of five classes of lower-cased text and title.

    lexicon has the lists reject, core, mechanism and context. In order: reject marks
    without the topic; no topic; topic outside the title, in an intervention context
    with core signals, or not; core signals, unless excluded or mechanistic;
    mechanism signals; else adjacent.
    """
    on, titled = alias_hit(text, aliases), alias_hit(title, aliases)
    core, mechanism = any_of(text, lexicon["core"]), any_of(text, lexicon["mechanism"])
    return (
        F.when(any_of(text, lexicon["reject"]) & ~on, "reject")
        .when(~on, "off_thesis")
        .when(~titled & any_of(text, lexicon["context"]) & core, "adjacent_clinical")
        .when(~titled, "off_thesis")
        .when(core & any_of(text, list(excluded)), "adjacent_clinical")
        .when(core & mechanism, "background_mechanism")
        .when(core, "core_on_thesis")
        .when(mechanism, "background_mechanism")
        .otherwise("adjacent_clinical")
    )


def paper_score(klass: Column, tier: Column, directness: Column, year: Column, current_year: int) -> Column:
    """Class score with bonuses for tier, directness and recency, from 0 to 100."""
    age = current_year - year
    recent = F.when(age <= 5, 10).when(age <= 10, 5).otherwise(0)
    raw = lookup(CLASS_SCORE, klass, 0) + lookup(TIER_BONUS, tier, 0) + lookup(DIRECTNESS_BONUS, directness, 0) + F.coalesce(recent, F.lit(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), raw))


def extraction_pool(klass: Column, tier: Column) -> Column:
    """core, background or adjacent for kept classes; primary tiers that are not rejected are rescued to adjacent."""
    return (
        F.when(klass == "core_on_thesis", "core").when(klass == "background_mechanism", "background").when(klass == "adjacent_clinical", "adjacent")
        .when(tier.isin(*PRIMARY_TIERS) & (klass != "reject"), "adjacent")
    )


def funnel(rows: DataFrame, klass: str = "class", pool: str = "pool") -> DataFrame:
    """(stage, n): rows in all, by class, by pool, kept and rescued, in one pass."""
    kept = F.col(pool).isNotNull()
    counts = {"all": F.lit(True), "kept": kept, "rescued": kept & ~F.col(klass).isin(*KEEP)}
    counts |= {f"class:{c}": F.col(klass) == c for c in CLASS_SCORE} | {f"pool:{p}": F.col(pool) == p for p in ("core", "background", "adjacent")}
    row = rows.agg(*[F.count_if(v).alias(k) for k, v in counts.items()])
    return row.unpivot([], list(counts), "stage", "n")


def first_class(text: Column, lexicon: dict[str, list[str]], default: str = "other") -> Column:
    """The first class of the lexicon with a term in the text."""
    out = F.lit(default)
    for k, terms in reversed(lexicon.items()):
        out = F.when(any_of(text, terms), k).otherwise(out)
    return out


def signals(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """All terms of all lists that occur, in order."""
    return F.flatten(F.array(*[hits(text, terms) for terms in lexicon.values()]))


def override(rows: DataFrame, ids: str, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces columns by those of the first override(id, ...) that an id of the row's array has.

    Only rows with ids are exploded; of several hits the smallest id's counts.
    """
    hit = rows.select("row_id", F.explode(ids).alias("id")).join(overrides, "id").groupBy("row_id").agg(*[F.min_by(c, "id").alias(f"_{c}") for c in columns])
    out = rows.join(hit, "row_id", "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns], F.coalesce(*[f"_{c}" for c in columns]).isNotNull().alias("overridden"))


def population_gate(rows: DataFrame, floor: int) -> DataFrame:
    """Drops animal rows that are not interventional if the human core outweighs them.

    rows(pool, population, interventional, ...). One row of counts decides for all:
    three human core rows at least, more than animal ones, and `floor` rows left.
    """
    stay = (F.col("population") != "animal") | F.col("interventional")
    core = F.col("pool") == "core"
    n = rows.agg(
        F.count_if(core & (F.col("population") == "human")).alias("h"), F.count_if(core & (F.col("population") == "animal")).alias("a"), F.count_if(stay).alias("left")
    ).select(((F.col("h") >= 3) & (F.col("h") > F.col("a")) & (F.col("left") >= floor)).alias("_drop"))
    return rows.join(F.broadcast(n)).where(~F.col("_drop") | stay).drop("_drop")
