"""Whether a trial's comparison isolates the intervention that it is read for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.outcomes import owned

# How trials state their arms, and what they share.
DASHES = r"[_\-‐-―]+"
REGIMEN = r"\s+(?:training|exercise|supplementation|treatment|therapy)$"
EVERYONE = r"\b(?:both|all)(?:\s+the)?\s+(?:groups|arms|participants|subjects)\s+(?:received|underwent|performed|completed|participated in)\s+(?:(?:the\s+)?(?:same|identical)\s+)?"
ALONGSIDE = r"\bwhile also (?:participating in|undergoing|completing|receiving)\s+([^.;]+)"
RANDOMIZED = r"\b(?:randomi[sz]ed|randomly assigned)\b"
DIVIDED = r"\bdivided into(?=[^.;\n]{0,160}\bplacebo\b)"
CONTRAST = (
    r"\b(?:randomi[sz]ed|randomly assigned|randomi[sz]ation)(?:\s+\w+){0,4}\s+(?:to|into)\s+(.+?)(?=(?<!\d)\.(?!\d)|[\n]|$)|\btrials comparing\s+([^.;\n]+)"
    r"|\beffects? of ([^.;]+? compared (?:to|with) [^.;]+?)(?= on | during | for |[.;]|$)"
)
AIM = r"\b(?:for|during|following|after|effects on)\b"
ARM_CUT = r";\s*(?:and\s+)?|\s+(?:or|versus|vs\.?|and|compared to|compared with)\s+|,\s*"
ANONYMOUS = (
    r"^(?:\d+(?:\.\d+)?\s*(?:mg|mcg|[µu]?g)(?:/\w+)?|(?:low|high|moderate) (?:dose|intensity|volume|frequency)|(?:group|arm) [a-z\d]+|placebo|control|intervention|treatment)$"
)
PLUS = r"\bplus\b|\+"
COMBINATION = r"\b(?:multi ingredient|combined supplementation|combination|combined [^.!?:]{0,100}\band\b)"
TWO_ARMS = r"\btwo (?:groups|arms)\b|\b(?:intervention|treatment) or control\b|\bgroup\s*\(\s*placebo,\s*intervention\s*\)"
USUAL_CARE = r"\bcontrols? (?:group )?maintained usual (?:lifestyle|care)\b|\bcontrol group (?:was )?treated with placebo\s*(?:[.!?]|\(group)|\bplacebo contained[^.!?]+\bonly\b"
SHARED = r"\b(?:both|all) groups (?:received|took|were given|were treated)\b|\bfactorial\b"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), DASHES, " ")


def _quoted(term: Column) -> Column:
    return F.regexp_replace(term, r"([^\p{L}\p{N} ])", r"\\$1")


def unisolated(trials: DataFrame) -> DataFrame:
    """trials(title, abstract, target, aliases, ...) with `unisolated`: the comparison does not isolate the target.

    It does not if everyone had the target; if it ran alongside a randomized comparison; if
    the arms of a stated contrast all lack it, or all have it with something more; or if a
    combination in the title was only compared with placebo or usual care. Sentences on
    others' work count for nothing. The target's names are its aliases, abbreviations in
    brackets behind them, and names without a regimen before "group" or "arm".
    """
    own = F.filter(F.split(F.coalesce("abstract", F.lit("")), r"(?<=[.!?])\s+"), lambda s: owned(s, F.lit("abstract")))
    rows = trials.withColumn("_a", _plain(F.array_join(own, " "))).withColumn("_t", _plain(F.col("title"))).withColumn("_g", F.trim(_plain(F.col("target"))))
    names = F.concat(F.array("_g"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), _plain))
    rows = rows.withColumn("_names", F.array_distinct(F.filter(names, lambda n: F.trim(n) != "")))
    short = F.flatten(F.transform("_names", lambda n: F.regexp_extract_all("_a", F.concat(F.lit(r"\b"), _quoted(n), F.lit(r"\s*\(([a-z]{2,5})\)")), F.lit(1))))
    rows = rows.withColumn("_names", F.array_distinct(F.concat("_names", short)))
    bare = F.filter(F.transform("_names", lambda n: F.regexp_replace(n, REGIMEN, "")), lambda n: ~F.array_contains("_names", n))
    parts = F.concat(F.transform("_names", _quoted), F.transform(bare, lambda n: F.concat(_quoted(n), F.lit(r"(?=\s+(?:group|arm)s?\b)"))))
    # No name matches nothing.
    rows = rows.withColumn("_re", F.when(F.size(parts) == 0, r"(?!)").otherwise(F.concat(F.lit(r"\b(?:"), F.array_join(parts, "|"), F.lit(r")\b"))))
    a = F.col("_a")
    everyone = (F.col("_g") != "") & F.rlike(a, F.concat(F.lit(EVERYONE), _quoted(F.col("_g")), F.lit(r"\b")))
    alongside = F.rlike(F.regexp_extract("_a", ALONGSIDE, 1), F.col("_re")) & a.rlike(RANDOMIZED)
    contrasts = F.regexp_extract_all(F.regexp_replace(a, DIVIDED, "randomized into"), F.lit(CONTRAST), F.lit(0))

    def arms(match: Column) -> Column:
        said = F.coalesce(*[F.nullif(F.regexp_extract(match, CONTRAST, g), F.lit("")) for g in (1, 2, 3)], F.lit(""))
        return F.split(F.regexp_replace(F.split(said, AIM, 2)[0], r"^.*?groups?:\s*", ""), ARM_CUT)

    rows = rows.withColumn("_arms", F.filter(F.transform(contrasts, arms), lambda x: (F.size(x) >= 2) & F.forall(x, lambda y: F.trim(y) != "")))
    has = lambda x: F.rlike(x, F.col("_re"))
    lacking = lambda x: ~F.exists(x, has) & ~F.forall(x, lambda y: F.trim(y).rlike(ANONYMOUS))
    with_more = lambda x: F.forall(x, has) & F.forall(x, lambda y: y.rlike(PLUS))
    contrasted = F.exists("_arms", lambda x: lacking(x) | with_more(x))
    target_is_one = ~(F.col("_g").rlike(COMBINATION) | F.col("_g").rlike(r"\band\b|\+")) & F.col("_t").rlike(COMBINATION)
    combined = target_is_one & a.rlike(TWO_ARMS) & a.rlike(USUAL_CARE) & ~a.rlike(SHARED)
    named = F.rlike(a, F.col("_re"))
    return rows.withColumn("unisolated", everyone | (named & (alongside | contrasted)) | combined).select(*trials.columns, "unisolated")
