"""Prefix trie of conversations: range minima over the LCPs of sorted conversations.

Sorted by their turns, the conversations that begin alike stand together, and how
far two neighbours agree (LCP) bounds each such stretch. A block of sorted
conversations keeps the minima of its LCPs over every power of two (a sparse
table). Each candidate prefix, a conversation and a depth beyond what it shares with
the one before, searches its left and right extent by itself, halving the step; no
stack walks the tree. Its members are an interval, so their count, smallest id and
sums come from a difference or two table entries.

Blocks come from a sort by range over the first turns and the id, so that copies of
one conversation, however many, lie in many blocks. A prefix that several blocks
hold is met by its hash, where counts add up. Totals over a subtree: a node belongs
to its smallest member. What a conversation owns is the end of its own path, so a
subtree's total is that of its members, but that the node's own smallest member
counts from the node's depth on. Member totals are summed by interval in a second
pass over blocks.

A turn is two hashes and a size; text is not shuffled. A conversation's turns are
one row, some 24 bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import cut

#: A block has at most about so many conversations and turns.
BLOCK_ROWS, BLOCK_TURNS = 1 << 14, 1 << 19
#: Turns by which conversations are dealt; they are sorted by all.
DEALT = 8
#: Characters of a text by which turns of equal number and role are ordered; then by hash.
HEAD = 64
ROOT = (0, 0)
_U = np.uint64


def sequences(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): each conversation's turns in order as structs of two hashes and the bytes of the text.

    Null turns come first, ties go by role, by the first HEAD characters of the text and
    by hash. A null role or text is empty; rows without an id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(
        F.col(turn_col).isNotNull().alias("z"), F.col(turn_col).alias("turn"), role.alias("role"), F.substring(text, 1, HEAD).alias("head"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(text, F.lit(1), role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    lists = convs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return lists.select("conv", F.transform("turns", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["bytes"].alias("bytes"))).alias("turns"))


def spliced(seqs: DataFrame, folds: int = 5, most: int = 8) -> DataFrame:
    """seqs(conv, turns), each behind the first h turns of conversation conv - conv % folds in place of its own first h.

    h is crc32(conv) % (most + 1). An absent conversation has no turns, a shorter one gives all.
    """
    heads = cut(seqs.where(F.col("conv") % folds == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most).alias("head")))
    own = seqs.withColumn("h", (F.crc32(F.col("conv").cast("string")) % (most + 1)).cast("int")).withColumn("base", F.col("conv") - F.col("conv") % folds)
    met = own.join(heads, "base", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return met.select("conv", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a ^ (a >> _U(31))) * _U(0x9E3779B97F4A7C15) + b + _U(salt)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Block:
    """Sorted conversations: their LCPs, sparse tables, and the nodes that they hold."""

    def __init__(self, conv: np.ndarray, sizes: np.ndarray, turns: np.ndarray):
        self.conv, self.sizes = conv, sizes
        n, self.at = len(conv), np.append(0, np.cumsum(sizes))
        h = turns.view(_U)
        self.ids = np.zeros((len(h), 2), _U)
        self.lcp = np.zeros(n, np.int64)
        open_, alike, depth = np.flatnonzero(sizes > 0), np.flatnonzero((sizes[1:] > 0) & (sizes[:-1] > 0)) + 1, 0
        while len(open_):
            place = self.at[open_] + depth
            for k in (0, 1):
                before = self.ids[place - 1, k] if depth else np.full(len(place), ROOT[k], _U)
                self.ids[place, k] = _mixed(before, h[place, k], k + 1)
            alike = alike[(h[self.at[alike] + depth] == h[self.at[alike - 1] + depth]).all(axis=1)]
            depth += 1
            self.lcp[alike] = depth
            alike = alike[(sizes[alike] > depth) & (sizes[alike - 1] > depth)]
            open_ = open_[sizes[open_] > depth]
        self.lows = self._table(self.lcp)
        # Candidates: the root, and each depth beyond what is shared with the conversation before.
        new = sizes - self.lcp
        self.first = np.append(0, np.repeat(np.arange(n), new))
        self.depth = np.append(0, np.arange(new.sum()) - np.repeat(np.cumsum(new) - new, new) + np.repeat(self.lcp, new) + 1)
        self.left, self.right = self._extents()

    @staticmethod
    def _table(x: np.ndarray) -> list[np.ndarray]:
        """Minima of every 1, 2, 4, ... neighbours."""
        rows = [x]
        while 2 << (len(rows) - 1) <= len(x):
            step = 1 << (len(rows) - 1)
            rows.append(np.minimum(rows[-1][:-step], rows[-1][step:]))
        return rows

    def _extents(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and last conversation that share each candidate: those up to which no LCP is below its depth."""
        left, right, n = self.first.copy(), self.first.copy(), len(self.conv)
        for k in range(len(self.lows) - 1, -1, -1):
            step, low = 1 << k, self.lows[k]
            fits = right + step < n
            fits[fits] = low[right[fits] + 1] >= self.depth[fits]
            right[fits] += step
            fits = left >= step
            fits[fits] = low[left[fits] - step + 1] >= self.depth[fits]
            left[fits] -= step
        return left, right

    def smallest(self) -> np.ndarray:
        """Each node's smallest member, from two overlapping entries of a table of ids."""
        table, size = self._table(self.conv), self.right - self.left + 1
        out, power = np.empty(len(size), np.int64), np.frexp(size)[1] - 1
        for k in np.unique(power):
            own = power == k
            out[own] = np.minimum(table[k][self.left[own]], table[k][self.right[own] - (1 << k) + 1])
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The total of members' values for each node."""
        run = np.append(0, np.cumsum(values))
        return run[self.right + 1] - run[self.left]

    def names(self, up: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of each node's prefix, or of its parent's."""
        depth = self.depth - up
        place = np.maximum(self.at[self.first] + depth - 1, 0)
        inner = depth > 0
        one = lambda k: np.where(inner, self.ids[place, k], _U(ROOT[k])).view(np.int64) if len(self.ids) else np.full(len(depth), ROOT[k])
        return one(0), one(1)

    def ends(self) -> Iterator[tuple[int, int, str]]:
        """(hashes, ids in order) of the conversations that end at one node."""
        same = np.append(False, (self.lcp[1:] == self.sizes[1:]) & (self.sizes[1:] == self.sizes[:-1]))
        starts = np.flatnonzero(~same)
        ids = self.ids.view(np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(self.conv)], strict=True):
            last = self.at[a + 1] - 1
            yield (*(ids[last].tolist() if self.sizes[a] else ROOT), ",".join(map(str, self.conv[a:b].tolist())))


def _blocks(batches: Iterator[pa.RecordBatch], limits: tuple[int, int]) -> Iterator[tuple[Block, np.ndarray, list[np.ndarray]]]:
    """(block, bytes of turns, other columns) of stretches of conv, path, bytes, ... rows."""
    held: list[pa.RecordBatch] = []
    rows = turns = 0

    def block() -> tuple[Block, np.ndarray, list[np.ndarray]]:
        t = pa.Table.from_batches(held).combine_chunks()
        path, size = (t.column(k).chunk(0) for k in (1, 2))
        sizes = np.diff(size.offsets.to_numpy())
        own = [t.column(i).to_numpy() for i in range(3, t.num_columns)]
        return Block(t.column(0).to_numpy(), sizes, path.flatten().to_numpy().reshape(-1, 2)), size.flatten().to_numpy(), own

    for b in batches:
        step = min(limits[0], 1024)
        for at in range(0, b.num_rows, step):
            held.append(b.slice(at, step))
            rows, turns = rows + held[-1].num_rows, turns + len(held[-1].column(2).flatten())
            if rows >= limits[0] or turns >= limits[1]:
                yield block()
                held, rows, turns = [], 0, 0
    if held:
        yield block()


def _dealt(rows: DataFrame) -> DataFrame:
    """Sorted by path within partitions. Any split into blocks gives the same result; this one keeps prefixes together."""
    return rows.repartitionByRange(F.slice("path", 1, 2 * DEALT), F.col("conv")).sortWithinPartitions("path", "conv")


NODE = ["id1", "id2"]


def _nodes(rows: DataFrame, limits: tuple[int, int]) -> DataFrame:
    """(part, seq, id1, id2, up1, up2, depth, n, conv, bytes, ends) of each block's nodes; rows with `ends` carry nothing else."""
    names = ["part", "seq", "id1", "id2", "up1", "up2", "depth", "n", "conv", "bytes", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, (b, sizes, _) in enumerate(_blocks(batches, limits)):
            last = np.maximum(b.at[b.first] + b.depth - 1, 0)
            size = np.where(b.depth > 0, sizes[last], 0) if len(sizes) else np.zeros(len(last), np.int64)
            columns = [*b.names(), *b.names(1), b.depth, b.right - b.left + 1, b.smallest(), size]
            k = len(last)
            head = [pa.array(np.full(k, part)), pa.array(np.full(k, seq))]
            yield pa.RecordBatch.from_arrays([*head, *[pa.array(c) for c in columns], pa.nulls(k, pa.string())], names)
            ends = list(b.ends())
            for at in range(0, len(ends), 4096):
                id1, id2, chunks = zip(*ends[at : at + 4096], strict=True)
                k = len(id1)
                head = [pa.array(np.full(k, part)), pa.array(np.full(k, seq)), pa.array(id1, pa.int64()), pa.array(id2, pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, *[pa.nulls(k, pa.int64())] * 6, pa.array(chunks, pa.string())], names)

    return cut(_dealt(rows).mapInArrow(run, ", ".join(f"{n} {'string' if n == 'ends' else 'long'}" for n in names)))


def _member_sums(rows: DataFrame, limits: tuple[int, int]) -> DataFrame:
    """(id1, id2, saved, leaves): members' totals of rows(conv, path, bytes, saved, leaves) for each node of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, weights in _blocks(batches, limits):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*b.names(), *map(b.sums, weights))], [*NODE, "saved", "leaves"])

    return _dealt(rows).mapInArrow(run, "id1 long, id2 long, saved long, leaves long").groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def _digests(chunks: DataFrame) -> DataFrame:
    """(id1, id2, ends_sha256) of chunks(id1, id2, part, seq, ends), hashed in order as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out: list[tuple] = []
            for id1, id2, ends in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if key != (id1, id2):
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (id1, id2), hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield record(out)
        if key:
            yield record([(*key, state.hexdigest())])

    def record(out: list[tuple]) -> pa.RecordBatch:
        id1, id2, found = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(id1, pa.int64()), pa.array(id2, pa.int64()), pa.array(found, pa.string())], [*NODE, "ends_sha256"])

    rows = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "part", "seq")
    return rows.select(*NODE, "ends").mapInArrow(run, "id1 long, id2 long, ends_sha256 string")


def prefix_trie(seqs: DataFrame, *, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie of seqs(conv, turns): see sequences().

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes below it, itself included), saved_tokens
    (over its subtree, bytes of a node's last text for every member but one),
    ends_sha256 (of the ids, in order, of conversations that end at the node). Two
    prefixes are one node if their turns' hashes agree, 128 bits in all. No
    conversation, no row; ids are different whole numbers.
    """
    rows = cut(seqs.select("conv", F.flatten(F.transform("turns", lambda t: F.array(t["h1"], t["h2"]))).alias("path"), F.col("turns.bytes").alias("bytes")))
    found = _nodes(rows, (block_rows, block_turns))
    one = [F.min(c).alias(c) for c in ("up1", "up2", "depth", "conv", "bytes")]
    nodes = cut(found.where("ends is null").groupBy(*NODE).agg(*one, F.sum("n").alias("n")))
    children = nodes.where("depth > 0").groupBy(F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.count("*").alias("children"))
    below = W.partitionBy("conv").orderBy(F.col("depth").desc())
    valued = nodes.join(children, NODE, "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long"))).withColumn("value", (F.col("n") - 1) * F.col("bytes"))
    leaf = F.when(F.col("children") == 0, 1).otherwise(0).cast("long")
    # What the owner has from this depth on; its first node has all.
    owned = cut(
        valued.withColumn("own_saved", F.sum("value").over(below)).withColumn("own_leaves", F.sum(leaf).over(below))
        .withColumn("top", F.col("depth") == F.min("depth").over(W.partitionBy("conv"))).drop("bytes", "value")
    )
    totals = cut(owned.where("top").select("conv", F.col("own_saved").alias("saved"), F.col("own_leaves").alias("leaves")))
    weighted = rows.join(totals, "conv", "left").select("conv", "path", "bytes", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("saved", "leaves")])
    members = _member_sums(weighted, (block_rows, block_turns))
    # Cut, so that the joins' sides are plain shuffles, whose hot keys Spark can split.
    parents = cut(nodes.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv").alias("parent_conv_id")))
    all_ = owned.join(totals.withColumnsRenamed({"saved": "all_saved", "leaves": "all_leaves"}), "conv").join(members, NODE)
    ended = all_.join(_digests(found.where("ends is not null").select(*NODE, "part", "seq", "ends")), NODE, "left")
    named = cut(ended.select(
        F.when(F.col("depth") > 0, F.col("up1")).alias("up1"), "up2", F.col("conv").alias("conv_id"), "depth", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        (F.col("leaves") - F.col("all_leaves") + F.col("own_leaves")).alias("n_leaves"), (F.col("saved") - F.col("all_saved") + F.col("own_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    ))
    return named.join(parents, ["up1", "up2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
