"""Text and identity expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0b]+", " "))


def clean_text(c: Column, limit: int = 1600) -> Column:
    """Drops tags, decodes the common entities, collapses white space and cuts at limit.

    Inline tags vanish; block tags become spaces.
    """
    x = F.regexp_replace(c, r"(?i)</?(b|i|em|strong|sub|sup|u|span)(\s[^>]*)?>", "")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.substring(collapse(x), 1, limit))


def normalize_doi(c: Column) -> Column:
    """Lower case, without resolver or scheme prefix; null unless it looks like a DOI."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")
    return F.when(x.rlike(r"^10\.[0-9]{4,9}/[^ ]+$"), x)


def title_signature(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def endpoint_key(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), " ")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def identity_keys(doi: Column, pmid: Column, nct: Column, abstract: Column, title: Column) -> Column:
    """Keys a record owns: DOI, PMID without leading zeros, registry numbers of its own
    and in its abstract; its title only if it has none of them."""
    bare = F.ltrim(missing(pmid), F.lit("0"))
    own = F.array(
        F.concat(F.lit("doi:"), F.lower(missing(doi))),
        F.concat(F.lit("pmid:"), F.when(bare == "", "0").otherwise(bare)),
        F.concat(F.lit("nct:"), F.upper(missing(nct))),
    )
    cited = F.transform(F.regexp_extract_all(F.upper(F.coalesce(abstract, F.lit(""))), F.lit(r"\bNCT[0-9]{7,9}\b"), 0), lambda x: F.concat(F.lit("nct:"), x))
    keys = F.array_distinct(F.concat(F.filter(own, lambda k: k.isNotNull()), cited))
    by_title = F.concat(F.lit("title:"), F.nullif(title_signature(title), F.lit("")))
    return F.when(F.size(keys) > 0, keys).otherwise(F.filter(F.array(by_title), lambda k: k.isNotNull()))


def dedupe_key(doi: Column, pmid: Column, nct: Column, title: Column) -> Column:
    """The strongest identity: DOI, PMID, registry number, else the title's first 80 characters."""
    return F.coalesce(
        F.concat(F.lit("doi:"), missing(doi)),
        F.concat(F.lit("pmid:"), missing(pmid)),
        F.concat(F.lit("nct:"), missing(nct)),
        F.concat(F.lit("title:"), F.substring(F.lower(F.coalesce(title, F.lit(""))), 1, 80)),
    )


def hits(text: Column, terms: list[str]) -> Column:
    """Terms that occur in the text, in the order of the list."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def bucket_of(text: Column, buckets: dict[str, list[str]], default: str = "unknown") -> Column:
    """First bucket with a term that occurs in the text."""
    out = F.lit(default)
    for name, terms in reversed(buckets.items()):
        out = F.when(any_of(text, terms), F.lit(name)).otherwise(out)
    return out


def any_of(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def canonical_number(c: Column) -> Column:
    """Without thousands separators, with a digit before the point."""
    x = F.regexp_replace(c, r"(?<=[0-9]),(?=[0-9]{3})", "")
    return F.when(x.startswith("."), F.concat(F.lit("0"), x)).otherwise(x)


def per_thousand_words(text: Column, pattern: str) -> Column:
    """Matches of a pattern per thousand words, to one decimal."""
    words = F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0b]+"), lambda w: w != ""))
    n = F.size(F.regexp_extract_all(text, F.lit(pattern), 0))
    return F.round(n * 1000.0 / F.greatest(words, F.lit(1)), 1)


def alpha_suffix(n: Column) -> Column:
    """0 is a, 25 is z, 26 is aa: bijective base 26, up to three letters."""
    letter = lambda k: F.chr(F.lit(97) + k)
    two, three = n - 26, n - 26 - 26 * 26
    return (
        F.when(n < 26, letter(n))
        .when(two < 676, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats."""
    common = F.size(F.array_intersect(a, b))
    return common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
