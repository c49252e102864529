"""SimHash near-dedup with bit-sliced comparison.

Fingerprints of 64 bits are made once per document. Equal ones collapse to a
representative. Of five blocks of bits, two at least agree between fingerprints
at most three bits apart, so every link lies in one of ten tables keyed by a pair
of blocks. Rows that share a key meet in a cell; a key with more than `CELL`
rows is dealt over a triangle of cells, each pair of parts meeting once, so that
no task holds more than two parts.

In a cell the fingerprints are stored as bit planes: word w of plane b has bit b
of 64 fingerprints. For a tile of queries, planes are added into carry-save
counters that keep 64 distances in each word and saturate beyond the radius;
words all of whose distances have exceeded it are abandoned. A cell gives a star
per local component, not its pairs; distributed components join the stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut
from weft.llm.graph import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Five blocks of the 64 bits as (first bit, width).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
CELL = 1 << 16
PACK = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE, chunk: int = 1 << 16) -> int:
    """The SimHash of one text as an unsigned number; null and wordless texts have 0."""
    from xxhash import xxh64_intdigest as h64

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(flat))
    n = max(1, len(words) - shingle + 1)
    lefts, rights = starts[:n], ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        spans = zip(lefts[at : at + chunk].tolist(), rights[at : at + chunk].tolist(), strict=True)
        h = np.fromiter(map(h64, [flat[a:b] for a, b in spans], repeat(SEED)), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += (np.ones(len(h), np.float32) @ bits.astype(np.float32)).astype(np.int64)  # exact: at most `chunk` each
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) for every row; the id keeps its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 to a word."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    wide = np.zeros((64, -(-n // 64) * 64), np.uint8)
    wide[:, :n] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, n: int, queries: np.ndarray, radius: int = RADIUS, dense: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query index, column index) at most `radius` bits apart."""
    width = planes.shape[1]
    levels = max(1, int(radius).bit_length())
    masks = np.where((queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    # The counters start so that they overflow at radius + 1.
    start = (1 << levels) - (radius + 1)
    shape = (len(queries), width)
    count = [np.full(shape, full if start >> k & 1 else 0, np.uint64) for k in range(levels)]
    over = np.zeros(shape, np.uint64)
    if n % 64:
        over[:, -1] = ~np.uint64((1 << n % 64) - 1)

    def add(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal over
        u = count[0] ^ x
        carry = (count[0] & x) | (u & y)
        count[0] = u ^ y
        for k in range(1, levels):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over = over | carry

    for b in range(0, dense, 2):
        add(planes[b][None, :] ^ masks[b][:, None], planes[b + 1][None, :] ^ masks[b + 1][:, None])
    qi, wi = np.nonzero(over != full)
    count, over = [c[qi, wi] for c in count], over[qi, wi]
    for b in range(dense, 64, 2):
        add(planes[b][wi] ^ masks[b][qi], planes[b + 1][wi] ^ masks[b + 1][qi])
        if b % 8 == 6:
            live = over != full
            if not live.all():
                qi, wi, over, count = qi[live], wi[live], over[live], [c[live] for c in count]
    bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, c = np.nonzero(bits)
    return qi[r], wi[r] * 64 + c


def local_roots(fps: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row of a cell the smallest id of its component within the cell.

    Rows of the largest component found so far are compared only with columns
    outside it, so a dense cell does not list its pairs.
    """
    n = len(fps)
    order = np.argsort(ids, kind="stable")
    x = fps[order]
    label = np.arange(n)
    tile = max(16, min(256, (1 << 22) // max(n, 1)))
    for at in range(0, n, tile):
        rows = np.arange(at, min(n, at + tile))
        big = np.bincount(label).argmax() if n > PACK and at else -1
        for rows, cols in ((rows[label[rows] != big], None), (rows[label[rows] == big], np.flatnonzero(label != big))):
            if not len(rows) or cols is not None and not len(cols):
                continue
            own = x if cols is None else x[cols]
            q, c = within(planes_of(own), len(own), x[rows], radius)
            a, b = rows[q], c if cols is None else cols[c]
            keep = a != b
            label = _merge(label, a[keep], b[keep])
    return ids[order][label][np.argsort(order, kind="stable")]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of a[i] and b[i]; a class is named by its smallest member."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) edges from rows sorted by cell; small cells are compared in packs.

    A pack compares rows of unlike cells too: a pair within the radius is a link
    wherever it is met.
    """
    cell, fp, rep = (np.empty(0, np.int64) for _ in range(3))

    def solve(f: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        f, first = np.unique(f.view(np.uint64), return_index=True)
        r = r[first]
        root = local_roots(f, r)
        off = root != r
        return pa.RecordBatch.from_arrays([pa.array(r[off]), pa.array(root[off])], ["a", "b"])

    def drain(stop: int) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate(([0], np.flatnonzero(cell[1:stop] != cell[: stop - 1]) + 1, [stop])) if stop else np.array([0])
        at = 0
        for left, right in zip(cuts[:-1], cuts[1:], strict=True):
            if right - at > PACK and left > at:
                yield solve(fp[at:left], rep[at:left])
                at = left
        if stop > at:
            yield solve(fp[at:stop], rep[at:stop])

    for b in batches:
        cell, fp, rep = (np.concatenate((old, b.column(i).to_numpy())) for i, old in enumerate((cell, fp, rep)))
        if len(cell) >= 4 * PACK:
            whole = int(np.searchsorted(cell, cell[-1]))
            yield from drain(whole)
            cell, fp, rep = cell[whole:], fp[whole:], rep[whole:]
    yield from drain(len(cell))


def near_links(reps: DataFrame, cell_rows: int = CELL) -> DataFrame:
    """Edges (a, b) that connect all of reps(fp, rep) within the radius."""
    mask = lambda i: F.shiftrightunsigned("fp", BLOCKS[i][0]).bitwiseAND(F.lit((1 << BLOCKS[i][1]) - 1))
    keys = [F.struct(F.lit(k).alias("t"), mask(i).alias("x"), mask(j).alias("y")) for k, (i, j) in enumerate(combinations(range(5), 2))]
    rows = reps.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", F.xxhash64("k.t", "k.x", "k.y").alias("key"))
    # Cut, so that both sides of the join are plain shuffles, whose hot keys Spark can split.
    met = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / cell_rows)
    own = F.pmod(F.xxhash64("fp", F.lit(1)), parts)
    cells = (
        rows.join(met, "key")
        .select("fp", "rep", "key", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp", "rep")
    )
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_stars, "a long, b long").distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges (a, b) that connect the rows of docs whose fingerprints link; ids are whole numbers, one to a row."""
    prints = cut(fingerprints(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "fp"))
    reps = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    equal = prints.join(reps, "fp").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return equal.union(near_links(reps))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at RADIUS or fewer differing bits; component_id is the
    smallest id reachable. Null, empty and wordless texts have fingerprint zero and
    link like any other. Rows that repeat an id give a row each and share links.
    Rows with a null id get a fingerprint and their component's smallest id.
    An empty table gives no rows. Ids are whole numbers.
    """
    prints = cut(fingerprints(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "fp"))
    reps = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    parts = connected_components(near_links(reps.where("rep is not null")))
    # A repeated id can stand for several fingerprints, and joins them.
    named = reps.join(parts, reps.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
