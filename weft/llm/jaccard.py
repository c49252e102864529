"""Near copies by exact Jaccard similarity of word-shingle sets.

Shingles are words as in `simhash`, five at a time. Equal sets collapse to a
representative. A set has BANDS keys of ROWS minima each; two sets with a
similarity of 0.8 share none with probability (1 - 0.8^4)^24, 3 in a million.
(Fingerprints of 64 bits would not do: at that similarity they differ in about ten
bits, and blocks that must agree at such a radius are too short to be keys.)

Representatives that share a key are candidates, and links are those whose sets
are found similar by intersecting them. First every one is held against the
smallest of each of its keys. Members of keys that this leaves unconnected, such as
documents that share a long passage, are held against each other by an exact
prefix join where a shingle is rare, and in blocks where it is not, so that no key
of any size is expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut
from weft.llm.graph import connected_components
from weft.llm.simhash import LOWER, SEED, _merge

SHINGLE = 5
#: Similarity of at least NUM / DEN, in whole numbers.
NUM, DEN = 4, 5
BANDS, ROWS = 24, 4
#: Sets under a shingle that are paired one by one; those under others meet in cells.
LIGHT = 16
CELL, CELL_ITEMS = 256, 400_000
#: Shingles of a matrix product.
SLICE = 4096
_RNG = np.random.default_rng(17)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one, a wordless one has none."""
    from xxhash import xxh64_intdigest as h64

    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(flat))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist(), strict=True)
    return np.unique(np.fromiter((h64(flat[a:b], SEED) for a, b in spans), np.uint64, n))


def band_keys(own: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """BANDS keys of a set that is not empty."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(own), chunk):
        least = np.minimum(least, ((own[at : at + chunk, None] ^ _FLIP) * _TIMES).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whole, keys = [], []
        for t in b.column(1):
            own = shingles(t.as_py())
            whole.append(blake2b(own.tobytes(), digest_size=16).digest())
            keys.append(band_keys(own).view(np.int64) if len(own) else [])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "whole", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [shingles(t.as_py()).view(np.int64) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], ["id", "own"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) whose sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("own").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("own").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return cut(pairs.join(left, "a").join(right, "b").where(both * (NUM + DEN) >= (F.size("x") + F.size("y")) * NUM).select("a", "b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of rows whose component has more than one, by its smallest id."""
    return connected_components(links(docs, id_col, text_col)).select(F.col("node").alias("id"), "component")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges (a, b) that connect what is similar.

    Ids are whole numbers, one to a row. Texts link at a similarity of NUM / DEN or
    more; wordless ones are equal to each other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    marked = cut(rows.mapInArrow(_marks, "id long, whole binary, keys array<long>"))
    reps = cut(marked.groupBy("whole").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("whole", "rep"))
    equal = cut(marked.select("id", "whole").join(reps, "whole").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    own = marked.select("id", "keys").join(equal, F.col("id") == F.col("a"), "left_anti").select("id", F.explode("keys").alias("key"))
    met = own.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    keyed = cut(own.join(met, "key").select("key", "id", "first"))

    wanted = keyed.select(F.col("id").alias("_id")).distinct()
    sets = cut(rows.join(wanted, F.col("id") == F.col("_id"), "left_semi").mapInArrow(_sets, "id long, own array<long>"))
    stars = _similar(keyed.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), sets)

    # What two hops connect; the rest is found connected at the end.
    hop = stars.groupBy("a").agg(F.min("b").alias("part"))
    up = hop.select(F.col("a").alias("part"), F.col("part").alias("up"))
    parts = hop.join(up, "part", "left").select(F.col("a").alias("node"), F.coalesce("up", "part").alias("component"))
    named = cut(keyed.join(parts, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("part")))
    split = named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    open_ = cut(named.join(split, "key", "left_semi"))
    members = cut(sets.join(open_.select("id", "part").distinct(), "id"))
    prefix = prefixes(members)
    more = _similar(light_pairs(prefix), members)
    crowded = prefix.where(F.col("held") > LIGHT).select("id").distinct()
    crowds = crowd_links(open_.join(crowded, "id", "left_semi"), members)
    return equal.union(stars).union(more).union(crowds)


def prefixes(sets: DataFrame) -> DataFrame:
    """(id, part, n, i, w, main, held): prefix shingles of sets(id, part, own) that more than one part has.

    Similar sets share one of their first n - ceil(n * NUM / DEN) + 1 shingles in
    any order that all use; here rarest first, so that a passage that many documents
    share is nobody's key until it is most of a document. i is the place of w in that
    order, main the part that has w most often and held the number of sets that do.
    """
    each = sets.select("id", "part", F.size("own").alias("n"), F.explode("own").alias("w"))
    often = each.groupBy("w").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles of one set alone come first and match nothing: only their number counts.
    shared = each.join(often, "w").groupBy("id", "part", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    alone = F.col("n") - F.size("o")
    first = F.col("n") - F.ceil(F.col("n") * NUM / DEN).cast("int") + 1 - alone
    keys = F.posexplode(F.slice("o", F.lit(1), F.greatest(first, F.lit(0)))).alias("i", "p")
    rows = cut(shared.select("id", "part", "n", alone.alias("alone"), keys).select("id", "part", "n", (F.col("i") + F.col("alone")).alias("i"), F.col("p.w").alias("w")))
    main = rows.groupBy("w", "part").agg(F.count("*").alias("c")).groupBy("w").agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("held"), F.count("*").alias("parts")).where("parts > 1")
    return cut(rows.join(main.select("w", F.col("m.part").alias("main"), "held"), "w"))


def light_pairs(prefix: DataFrame) -> DataFrame:
    """(a, b), a > b, of unlike parts under shingles that LIGHT sets hold at most, if their places leave a similarity possible."""
    met = prefix.where(F.col("held") <= LIGHT)
    x, y = met.where("part <> main").alias("x"), met.alias("y")
    c = lambda f, n: f(F.col(f"x.{n}"), F.col(f"y.{n}"))
    after = lambda s: F.col(f"{s}.n") - F.col(f"{s}.i") - 1
    most = c(F.least, "i") + 1 + F.least(after("x"), after("y"))
    on = (F.col("x.w") == F.col("y.w")) & (F.col("x.part") != F.col("y.part")) & (most * (NUM + DEN) >= (F.col("x.n") + F.col("y.n")) * NUM)
    return x.join(y, on).select(c(F.greatest, "id").alias("a"), c(F.least, "id").alias("b")).distinct()


def crowd_links(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is similar under a key of keyed(key, id, part).

    A key's sets are dealt into blocks of about CELL sets and CELL_ITEMS shingles, and
    each two blocks are a cell, compared in one place by matrix products; only links
    leave it, a tree for each cell's groups.
    """
    own = keyed.join(sets.select("id", "own", F.size("own").alias("n")), "id")
    blocks = F.ceil(F.greatest(F.count("*") / CELL, F.sum("n") / CELL_ITEMS)).cast("int").alias("blocks")
    wide = keyed.join(sets.select("id", F.size("own").alias("n")), "id").groupBy("key").agg(blocks, F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key", "blocks")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    dealt = own.join(wide, "key").select("key", "id", "part", "own", block, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = dealt.groupBy("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    return cut(cells.applyInArrow(_cell, "a long, b long").distinct())


def _cell(rows: pa.Table) -> pa.Table:
    """Links of one cell, each from a set to the smallest of its group."""
    rows = rows.combine_chunks().sort_by("id")
    ids, part = (rows.column(c).to_numpy() for c in ("id", "part"))
    own = rows.column("own").combine_chunks()
    flat, size = own.flatten().to_numpy(), np.diff(own.offsets.to_numpy())
    of = np.repeat(np.arange(len(ids)), size)
    _, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
    # A shingle of one set is in no intersection.
    keep = seen[at] > 1
    of, at = of[keep], (np.cumsum(seen > 1) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    both = np.zeros((len(ids), len(ids)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, SLICE):
        s, e = np.searchsorted(at, [low, low + SLICE])
        m = np.zeros((len(ids), SLICE), np.float32)
        m[of[s:e], at[s:e] - low] = 1
        both += m @ m.T
    alike = (both * (NUM + DEN) >= (size[:, None] + size[None, :]) * NUM) & (part[:, None] != part[None, :])
    a, b = np.nonzero(np.triu(alike, 1))
    root = _merge(np.arange(len(ids)), a, b)
    off = root != np.arange(len(ids))
    return pa.table({"a": ids[off], "b": ids[root[off]]})
