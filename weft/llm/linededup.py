"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that are not blank, each hashed after its
outer white space is dropped. From every window of `window` consecutive GRAM-line
hashes the smallest is kept as a fingerprint, so that runs of
window + GRAM - 1 = RUN lines that occur twice share one for certain. Fingerprints
that occur once are finished. Around the others, hashes of RUN lines are made at
every place that could hold a repeated run, which extends a match both ways for
as long as it goes; of equal runs the first by (document, place) stays, and the
lines of later ones go. A line, or two lines, of LONG_WORDS words or more are a
run by themselves.

Documents are told apart by id and a hash of the text. Fingerprints are one hash,
since a false match costs only work; runs, which decide, are two.

Fingerprints and runs are counted and joined by hash, with partial counts map
side; a run that a third of all documents share makes one row an occurrence and
is never gathered. Only documents that lose lines are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import WS_CHARS, cut, word_count

RUN, GRAM = 3, 2
LONG_WORDS = 40


def _line(raw: Column) -> Column:
    return F.btrim(raw, F.lit(WS_CHARS))


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _doc(id_col: str, text_col: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, long_words: int = LONG_WORDS) -> DataFrame:
    """(id, doc, h, g, long, pair): two hashes of each of a document's lines that are not
    blank, and the places where one line, or two, are long."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), _line), lambda x: x != "")
    full = docs.select(F.col(id_col).alias("id"), _doc(id_col, text_col).alias("doc"), lines.alias("lines"))
    rows = full.select("id", "doc", F.transform("lines", lambda x: F.struct(x.alias("x"), word_count(x).alias("n"))).alias("lines"))
    places = lambda n: F.filter(F.transform("lines", lambda s, i: F.when(n(s, i) >= long_words, i)), lambda i: i.isNotNull())
    return rows.select(
        "id",
        "doc",
        F.transform("lines", lambda s: F.xxhash64(s["x"])).alias("h"),
        F.transform("lines", lambda s: F.xxhash64(F.lit(1), s["x"])).alias("g"),
        places(lambda s, i: s["n"]).alias("long"),
        places(lambda s, i: s["n"] + F.get("lines", i + 1)["n"]).alias("pair"),
    )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, run: int = RUN, gram: int = GRAM, long_words: int = LONG_WORDS) -> DataFrame:
    """(id, doc, gone): for each document that loses lines, their numbers from 0, not counting blank ones, in order."""
    hashed = cut(line_hashes(docs, id_col, text_col, long_words))
    window = run - gram + 1
    grams = F.transform(_range(F.size("h") - (gram - 1)), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(gram)]))
    own = hashed.select("doc", grams.alias("m"))
    least = lambda i: F.least(*[F.struct(F.get("m", i + j).alias("mark"), (i + j).alias("at")) for j in range(window)])["at"]
    kept = F.array_distinct(F.transform(_range(F.size("m") - (window - 1)), least)) if window > 1 else _range(F.size("m"))
    prints = own.select("doc", "m", F.explode_outer(kept).alias("at")).where("at is not null").select("doc", "at", F.get("m", F.col("at")).alias("mark"))
    # Cut, here and below, so that both sides of a join are plain shuffles, whose hot keys Spark can split.
    again = cut(prints.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    met = prints.join(again, "mark", "left_semi").groupBy("doc").agg(F.collect_set("at").alias("at"))
    # Runs around a match: a place is extended to every run that holds its gram.
    places = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(p - (run - gram), F.lit(0)), p))))
    lines = ["id", "doc", "h", "g"]
    around = hashed.select(lines).join(met, "doc").select(*lines, F.explode_outer(F.filter(places, lambda p: p + run <= F.size("h"))).alias("at"))

    def keyed(found: DataFrame, n: int) -> DataFrame:
        keys = [F.xxhash64(F.lit(n), *[F.get(c, F.col("at") + j) for j in range(n)]).alias(f"key_{c}") for c in ("h", "g")]
        return found.where("at is not null").select("id", "doc", *keys, "at", F.lit(n).alias("n"))

    alone = [keyed(hashed.select(*lines, F.explode_outer(c).alias("at")), n) for c, n in (("long", 1), ("pair", 2))]
    runs = cut(keyed(around, run).union(alone[0]).union(alone[1]))
    key = ["key_h", "key_g"]
    # Places by plain numbers, which need no sort; equal rows of docs have equal places.
    ends = runs.groupBy(*key).agg(*[f(c).alias(f"{k}_{c}") for c in ("doc", "at") for k, f in (("lo", F.min), ("hi", F.max))])
    many = cut(ends.where("lo_doc < hi_doc or lo_at < hi_at").select(*key))
    shared = cut(runs.join(many, key, "left_semi"))
    place = F.struct(F.col("id").isNull().alias("z"), "id", "doc", "at")
    first = cut(shared.groupBy(*key).agg(F.min(place).alias("first")))
    later = shared.join(first, key).where(place != F.col("first"))
    spread = later.select("id", "doc", F.explode_outer(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("line"))
    return spread.groupBy("id", "doc").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, run: int = RUN, gram: int = GRAM, long_words: int = LONG_WORDS) -> DataFrame:
    """One row per input row: id, text without later repeated runs, n_lines, n_removed.

    n_lines counts lines that are not blank. Kept lines, blank ones too, stay as they
    are and are joined by newlines. Null text stays null with no lines; texts that
    lose every line are blank or empty. Within a document the same rule holds: of
    overlapping repeats the first stays. Rows that agree in id, null too, and in text
    count as one document: a run they share is not a repeat, and they lose the same
    lines. Rows of one id with different texts are documents of their own. A null id
    comes after others. An empty table gives no rows.
    """
    gone = repeated_lines(docs, id_col, text_col, run=run, gram=gram, long_words=long_words).select(F.col("id").alias("_id"), F.col("doc").alias("_doc"), "gone")
    rows = docs.select(F.col(id_col).alias("id"), _doc(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    rows = rows.join(gone, (F.col("doc") == F.col("_doc")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    raw = rows.select("id", "text", "gone", F.split("text", "\n").alias("raw"))
    full = F.filter(F.transform("raw", lambda x, i: F.when(_line(x) != "", i)), lambda i: i.isNotNull())
    lines = raw.select("id", "text", "gone", "raw", full.alias("full"))
    stay = F.array_except(_range(F.size("raw")), F.transform("gone", lambda i: F.get("full", i)))
    return lines.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("raw", i)), "\n")).alias(text_col),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("full")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
