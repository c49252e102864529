"""Similarity of texts and vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import jaccard, tokens
from weft.operators.select import cut


#: Names that are sent to all executors take up at most so many bytes.
SENT_BYTES = 32 << 20
#: A set's row takes up about so many bytes with its id.
NAMED = 64
#: Sets that are taken apart at once.
AT_ONCE = 1024


def _classes(most: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(least size, parts) of the classes of sizes up to `most`.

    The largest size of a class is its least over the threshold, so a set and a smaller one
    that similar are of one class or of neighbours. The sizes of a class leave two such
    sets one member less apart than the class has parts.
    """
    least, parts, lo = [], [], 1
    while lo <= most:
        hi = max(lo, math.floor(lo / threshold + 1e-9))
        least.append(lo)
        parts.append(math.floor(hi * (1 - threshold) / threshold + 1e-9) + 1)
        lo = hi + 1
    return np.array(least, np.int64), np.array(parts, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(batch: pa.RecordBatch, threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, n, parity, key, smaller) for each part of each set of batch(id, t), t not empty: see similar_sets()."""
    for at in range(0, batch.num_rows, AT_ONCE):
        b = batch.slice(at, AT_ONCE)
        n = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        h = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        parity = np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), np.cumsum(n) - n).view(np.int64)
        least, parts = _classes(int(n.max()), threshold)
        own = np.searchsorted(least, n, "right") - 1
        for smaller, c in ((True, own), (False, own - 1)):
            # A class of one part has equal sets only.
            k = np.where((c >= 0) & (parts[c] > 1), parts[c], 0)
            held = k[row] > 0
            base = np.cumsum(k) - k
            part = (h[held] >> np.uint64(8)) % k[row[held]].astype(np.uint64)
            sums = np.zeros(int(k.sum()), np.uint64)
            np.add.at(sums, base[row[held]] + part.astype(np.int64), _mixed(h[held]))
            of = np.repeat(np.arange(len(n)), k)
            place = (np.arange(len(of)) - base[of] + (c[of] << 32)).astype(np.uint64)
            key = _mixed(sums + _mixed(place + np.uint64(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(n[of].astype(np.int32)), pa.array(parity[of]), pa.array(key), pa.array(np.full(len(of), smaller))], ["id", "n", "parity", "key", "smaller"])


def _sent_or_not(rows: DataFrame) -> DataFrame:
    """rows of ids, written, for a join: sent to all executors if they take up SENT_BYTES or less."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() * NAMED <= SENT_BYTES else rows


def similar_sets(rows: DataFrame, id_col: str, tokens_col: str, threshold: float = 0.9, least: int = 1) -> DataFrame:
    """(a, b, similarity) of distinct token sets with Jaccard >= threshold, a < b, and
    each row's set: see members().

    Equal sets are one: a is the smallest id of its set. The join is exact (Arasu, Ganti
    and Kaushik, 2006): two sets that similar differ in at most
    d = size * (1 - threshold) / threshold members, so if tokens are dealt over d + 1
    parts by hash, the sets agree in all of a part. A set has a key for each of its parts,
    about ten tokens at 0.9, so few but similar sets meet under a key, however frequent
    single tokens are. The number of parts goes by classes of sizes, and a set has the keys
    of its own class and, as the larger one, of the class below. What meets goes on only if
    sizes, and the bits in which the sets' parity bitmaps differ (no more than members
    that one set has alone), leave it possible; token arrays are sent for similar sets
    only. Tokens are compared by 64-bit hashes, sets by two.
    """
    # Smaller sets have no other set that similar.
    least = max(least, 1, math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else 1)
    hashed = F.array_sort(F.array_distinct(F.transform(tokens_col, lambda x: F.xxhash64(x))))
    sets = rows.select(F.col(id_col).alias("id"), hashed.alias("t")).where(F.size("t") >= least)
    sets = cut(sets.select("id", "t", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g")))
    first = sets.groupBy("h", "g").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    gone = sets.select("id", "h", "g").join(first, ["h", "g"]).where("id <> first").select("id", "h").distinct()
    reps = sets.join(_sent_or_not(gone), ["id", "h"], "left_anti").select("id", "t")
    kind = reps.schema["id"].dataType.simpleString()
    signed = reps.mapInArrow(lambda batches: (out for b in batches for out in _signed(b, threshold)), f"id {kind}, n int, parity long, key long, smaller boolean")
    x, y = signed.where("smaller").drop("smaller").alias("x"), signed.alias("y")
    na, nb = F.col("x.n"), F.col("y.n")
    long_enough = (na >= nb * threshold - 1e-9) & (nb >= na * threshold - 1e-9)
    need = (na + nb) * (threshold / (1 + threshold)) - 1e-9
    apart = F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity"))) <= na + nb - 2 * need
    # Sets of one class meet once.
    ordered = ~F.col("y.smaller") | (F.col("x.id") < F.col("y.id"))
    near = x.join(y, (F.col("x.key") == F.col("y.key")) & ordered & long_enough & apart).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    near = _sent_or_not(near)
    ta = reps.join(near, F.col("id") == F.col("a")).select("a", "b", F.col("t").alias("ta"))
    tb = reps.join(near, F.col("id") == F.col("b")).select("a", "b", F.col("t").alias("tb"))
    scored = ta.join(tb, ["a", "b"]).select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold - 1e-12)


def members(rows: DataFrame, id_col: str, tokens_col: str, least: int = 1) -> DataFrame:
    """(id, representative): the smallest id with the same token set."""
    sets = rows.select(F.col(id_col).alias("id"), F.sha2(F.array_join(F.array_sort(F.array_distinct(tokens_col)), " "), 256).alias("k"), F.size(F.array_distinct(tokens_col)).alias("n")).where(F.col("n") >= least)
    return sets.join(sets.groupBy("k").agg(F.min("id").alias("representative")), "k").select("id", "representative")


def distinct_lines(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep..., line_id, t): the distinct lines of documents, by hash, and their tokens."""
    lines = docs.select(*keep, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line")).distinct()
    return lines.select(*keep, F.md5("line").alias("line_id"), tokens(F.col("line")).alias("t"))


def near_duplicate_lines(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.9, least: int = 20) -> DataFrame:
    """similar_sets over the distinct lines of at least `least` different tokens; ids are line hashes."""
    return similar_sets(distinct_lines(docs, text_col), "line_id", "t", threshold, least)


def line_members(docs: DataFrame, id_col: str, text_col: str, least: int = 20) -> DataFrame:
    """(line_id, id, representative): documents' lines and the line that stands for their token set.

    A line goes on as its hash and two hashes of its token set; no text is shuffled.
    """
    lines = docs.select(id_col, F.explode(F.array_distinct(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))).alias("line"))
    sets = lines.select(id_col, F.md5("line").alias("line_id"), F.array_sort(F.array_distinct(tokens(F.col("line")))).alias("t")).where(F.size("t") >= least)
    own = cut(sets.select(id_col, F.unhex("line_id").alias("l"), F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g")).distinct())
    first = own.groupBy("h", "g").agg(F.min("l").alias("first"))
    text = lambda c: F.lower(F.hex(c))
    return own.join(first, ["h", "g"]).select(text("l").alias("line_id"), id_col, text("first").alias("representative"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists, without objects for numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


#: Query vectors of at most so many bytes are broadcast.
QUERY_BYTES = 64 << 20


def cosine_search(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, limit: float, block: int = 1024, max_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, match, cosine) of stated queries against all vectors, from `limit` on. A null vector is left out.

    Vectors are read once. Queries of max_bytes or less are broadcast and meet each batch
    of vectors where it lies, `block` of them a matrix product. More are packed into
    blocks, as the vectors are, and each pair of blocks is a row.
    """
    plain = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    rows, named = plain(vectors), plain(queries)
    n, numbers = named.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    found = _sent(named, rows, limit, block) if 8 * numbers <= max_bytes else _packed(named, rows, limit, block, n)
    return found.where("query <> match")


def _matches(ids: np.ndarray, q: np.ndarray, others: np.ndarray, v: np.ndarray, limit: float, block: int) -> Iterator[pa.RecordBatch]:
    """Matches of unit rows q and v, a block of q at a time."""
    for at in range(0, len(ids), block):
        c = q[at : at + block] @ v.T
        i, j = np.nonzero(c >= limit)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at + i]), pa.array(others[j]), pa.array(c[i, j])], ["query", "match", "cosine"])


FOUND = "query long, match long, cosine double"


def _sent(named: DataFrame, rows: DataFrame, limit: float, block: int) -> DataFrame:
    t = named.toArrow()  # checked: at most max_bytes
    ids = t.column(0).to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast((ids, _unit(_matrix(t.column(1).combine_chunks())) if len(ids) else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for b in batches:
            if len(ids) and b.num_rows:
                yield from _matches(ids, q, b.column(0).to_numpy(), _unit(_matrix(b.column(1))), limit, block)

    return rows.mapInArrow(run, FOUND)


def _packed(named: DataFrame, rows: DataFrame, limit: float, block: int, n: int) -> DataFrame:
    def blocks(d: DataFrame, count: int, size: int, name: str) -> DataFrame:
        parts = max(1, -(-count // size))
        own = d.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(f"{name}_n")).agg(F.collect_list(F.struct("id", "v")).alias("vs"))
        return cut(own.select(f"{name}_n", F.col("vs.id").alias(f"{name}_ids"), F.flatten("vs.v").alias(f"{name}_v")))

    left, right = blocks(named, n, block, "q"), blocks(rows, rows.count(), 4 * block, "v")
    parts = max(1, -(-n // block))
    # Numbers of blocks, which then draw what they name.
    pairs = right.select("v_n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q_n"))
    met = pairs.join(left, "q_n").join(right, "v_n").select("q_ids", "q_v", "v_ids", "v_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, q, others, v = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(4))
                yield from _matches(ids, _unit(q.reshape(len(ids), -1)), others, _unit(v.reshape(len(others), -1)), limit, block)

    return met.mapInArrow(run, FOUND)


def close_pairs(vectors: DataFrame, group: str, id_col: str, vector_col: str, limit: float, block: int = 512) -> DataFrame:
    """(group, early, late) of vectors of one group whose cosine exceeds the limit, early < late.

    A group is cut into blocks of about `block` vectors; a pair of blocks is one matrix
    product, and only pairs beyond the limit leave it.
    """
    sized = vectors.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    rows = vectors.join(sized, F.col(group).eqNullSafe(F.col("_g"))).select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int").alias("n"))
    parts = cut(rows.groupBy("g", "n").agg(F.collect_list(F.struct("id", "v")).alias("vs")))
    left, right = parts.select("g", F.col("n").alias("n1"), F.col("vs").alias("x")), parts.select(F.col("g").alias("g2"), F.col("n").alias("n2"), F.col("vs").alias("y"))
    met = left.join(right, F.col("g").eqNullSafe(F.col("g2")) & (F.col("n1") <= F.col("n2"))).select("g", (F.col("n1") == F.col("n2")).alias("same"), F.col("x.id").alias("xi"), F.flatten("x.v").alias("xv"), F.col("y.id").alias("yi"), F.flatten("y.v").alias("yv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                same, xi, xv, yi, yv = (b.column(c)[k].values.to_numpy(zero_copy_only=False) if c > 1 else b.column(c)[k].as_py() for c in range(1, 6))
                i, j = np.nonzero(_unit(xv.reshape(len(xi), -1)) @ _unit(yv.reshape(len(yi), -1)).T > limit)
                keep = (xi[i] < yi[j]) if same else np.ones(len(i), bool)
                lo, hi = np.minimum(xi[i], yi[j])[keep], np.maximum(xi[i], yi[j])[keep]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(lo), b.schema.field(0).type), pa.array(lo), pa.array(hi)], ["g", "early", "late"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (group, id_col)}
    return met.mapInArrow(run, f"g {kinds[group]}, early {kinds[id_col]}, late {kinds[id_col]}")
