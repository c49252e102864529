"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive benchmark words. Every window of k-gram hashes of
width w keeps its smallest, so texts that share w + k - 1 = WINDOW words share a
kept hash. The distinct kept hashes of a document are joined with those of the
benchmark; the few that meet are extended, word by word, to the windows around
every position of that k-gram, and a window counts if its words are a benchmark
window's. Items shorter than a window are windows themselves; documents are
then also cut into grams of those lengths (at most WINDOW - 1 of them).

Document words stay in their row. Rows are exploded only to distinct
fingerprints, which a broadcast of the benchmark's fingerprints thins out before
any shuffle. With more than BROADCAST_ROWS of them, (document, fingerprint) rows
are joined by a shuffle, and the words of documents that met some are read again.
The join sees distinct hashes on the benchmark's side, so a phrase that many items
share does not multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut

WINDOW = 10
GRAM = 5
#: A row is two longs: at most 64 MB in memory.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z alone.

    Upper-case letters are first taken as parts of words and lower-cased word by
    word where there are any.
    """
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
    return F.transform(raw, lambda w: F.when(w == F.lower(w), w).otherwise(F.translate(w, UPPER, LOWER)))


def _range(n: Column) -> Column:
    """0 .. n - 1, empty if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, k: int) -> Column:
    """Hash of each k consecutive words, with k in it."""
    return F.transform(_range(F.size(words) - (k - 1)), lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]))


def _minima(grams: Column, w: int) -> Column:
    """Smallest hash of each w consecutive ones."""
    if w == 1:
        return grams
    return F.transform(_range(F.size(grams) - (w - 1)), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)]))


def _with_marks(rows: DataFrame, families: list[tuple[int, int, int]]) -> DataFrame:
    """rows(words, ...) with `marks`, the distinct kept hashes of all families.

    Hashes are a column before minima are taken: named inside a lambda they would
    be made again for each element. (Hence explode_outer in this module: a plain
    explode has a filter on its array's size inferred, which is pushed below these
    columns by repeating their expressions.)
    """
    for k in sorted({k for _, k, _ in families}):
        rows = rows.withColumn(f"grams{k}", _grams(F.col("words"), k))
    kept = F.array_distinct(F.concat(*[_minima(F.col(f"grams{k}"), w) for _, k, w in families]))
    return rows.withColumn("marks", kept).drop(*[f"grams{k}" for _, k, _ in families])


def _joined(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, n), " ")


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, n, gram): each item's windows as text, n words long."""
    rows = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).withColumn("size", F.size("words"))
    n = F.least(F.lit(window), F.col("size"))
    return (
        rows.where("size > 0")
        .select("item", "words", n.alias("n"), F.explode_outer(_range(F.col("size") - n + 1)).alias("at"))
        .select("item", "n", _joined(F.col("words"), F.col("at"), F.col("n")).alias("gram"))
        .distinct()
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = WINDOW,
    gram: int = GRAM,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(hits, spans): one row per document with a hit, and one per hit window.

    hits: id, n_hit (words inside any occurrence), items (sorted ids as text).
    spans: id, at (first word, from 0), n (words), gram. Documents without words
    and items without words give nothing; rows that repeat an id pool their hits.
    Rows whose id is null pool as one document. Items whose id is null count as
    the item "".
    """
    named = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text_col).alias("text"))
    grams = cut(benchmark_windows(named, "item_id", "text", window))
    # At most `window` numbers: the lengths of short items, and the full one.
    short = sorted(r.n for r in grams.where(F.col("n") < window).select("n").distinct().collect())
    families = [(window, gram, window - gram + 1)] + [(n, n, 1) for n in short]
    per_window = grams.select("n", "gram").distinct().withColumn("words", F.split("gram", " "))
    marks = None
    for n, k, w in families:
        part = _with_marks(per_window.where(F.col("n") == n), [(n, k, w)]).select("n", F.lit(k).alias("k"), F.explode_outer("marks").alias("mark"))
        marks = part if marks is None else marks.union(part)
    marks = cut(marks.distinct())
    small = marks.count() <= broadcast_rows
    n_grams, n_bytes = grams.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).first()
    keys = per_window.select("n", "gram")
    # Windows may hold words of any length, so their bytes count.
    keys = F.broadcast(keys) if n_grams <= broadcast_rows and n_bytes <= broadcast_bytes else keys

    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    if small:
        met = _with_marks(rows, families).select("id", "words", F.explode_outer("marks").alias("mark")).join(F.broadcast(marks), "mark")
    else:
        # The hash tells rows of one id apart; rows that agree in it share fingerprints, which are checked below.
        named = rows.withColumn("h", F.xxhash64("id", "words"))
        found = _with_marks(named, families).select("h", F.explode_outer("marks").alias("mark")).join(marks.hint("merge"), "mark")
        own = found.groupBy("h").agg(F.collect_set(F.struct("mark", "n", "k")).alias("own"))
        met = named.join(own, "h").select("id", "words", F.explode_outer("own").alias("o")).select("id", "words", "o.mark", "o.n", "o.k")
    same = F.lit(None).cast("array<int>")
    for k in sorted({k for _, k, _ in families}):
        own = F.transform(_grams(F.col("words"), k), lambda g, i: F.when(g == F.col("mark"), i))
        same = F.when(F.col("k") == k, F.filter(own, lambda i: i.isNotNull())).otherwise(same)
    spread = F.array_distinct(
        F.flatten(F.transform(same, lambda p: F.sequence(F.greatest(p - F.col("n") + F.col("k"), F.lit(0)), F.least(p, F.size("words") - F.col("n")))))
    )
    spans = (
        met.where(F.size("words") >= F.col("n"))
        .select("id", "words", "n", F.explode_outer(spread).alias("at"))
        .select("id", "at", "n", _joined(F.col("words"), F.col("at"), F.col("n")).alias("gram"))
        .join(keys, ["n", "gram"], "left_semi")
        .distinct()
    )
    spans = cut(spans.select("id", "at", "n", "gram"))
    # A document's spans are no more than its words.
    covered = (
        spans.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("s"))
        .select("id", F.aggregate("s", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), _cover)["n"].alias("n_hit"))
    )
    found = (
        spans.select("id", "n", "gram").distinct().join(grams, ["n", "gram"]).select("id", "item").distinct()
        .groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    hits = covered.join(found, covered.id.eqNullSafe(found.id)).select(covered.id, "n_hit", "items")
    return hits, spans


def _cover(state: Column, s: Column) -> Column:
    """Adds a span, in order of starts, to the number of covered words."""
    new = F.greatest(s["end"] - F.greatest(state["end"], s["at"]), F.lit(0))
    return F.struct(F.greatest(state["end"], s["end"]).alias("end"), (state["n"] + new).alias("n"))


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items, contaminated.

    A document with null text has no words. Documents are told apart by id and text, so
    rows that share an id, null too, do not share hits. See contamination() for the rest.
    """
    # A null id beside the hash is a value like another.
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("print"))
    keyed = docs.select(key.alias("_key"), F.col(text_col).alias("_text"))
    hits, _ = contamination(keyed, items, "_key", "_text", item_id_col, item_text_col)
    sizes = keyed.select("_key", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    hits = hits.select(F.col("id").alias("_hit"), "n_hit", "items")
    same = F.col("_key.id").eqNullSafe(F.col("_hit.id")) & (F.col("_key.print") == F.col("_hit.print"))
    return sizes.join(hits, same, "left").select(
        F.col("_key.id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
