"""URL filter: a Bloom filter cascade over the corpus's complete key universe.

The first level holds the listed keys; the second the unlisted keys that pass
the first; the third the listed keys that pass the second; and so on until a
level has no false positives left. Over the universe it was built from, the
first level that a key fails decides exactly whether it is listed.

Keys are dealt to shards by hash; one task builds the cascade of one shard
of about SHARD_KEYS keys. The cascades' total size is known before they are used:
up to MAX_BYTES they are broadcast and pages are judged where they lie. Beyond,
pages are sent to the cascades: those of a shard in groups of about GROUP_ROWS,
each with a copy of the shard's cascade, so that neither a shard nor a host that
a third of all pages have is one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import cut

SHARD_KEYS = 100_000
MAX_BYTES = 64 << 20
GROUP_ROWS = 200_000
MOST_LEVELS = 64
BITS_PER_KEY, HASHES = 10, 5
#: (host suffix, path prefix, verdict): the most specific rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_URL_UPPER, _URL_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _URL_UPPER, _URL_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(suffix + prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """HASHES bit positions for each key; every level mixes its own number in."""
    a = h1 ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(29)
    b = (h2 + np.uint64(level)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the levels, for distinct pairs (h1, h2).

    A listed and another key with the same pair pass every level: an error.
    """
    levels: list[np.ndarray] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) == MOST_LEVELS:
            raise ValueError("a listed and an unlisted key have the same two hashes")
        bits = max(64, len(inside) * BITS_PER_KEY)
        table = np.zeros(bits, bool)
        table[_slots(h1[inside], h2[inside], len(levels), bits).ravel().astype(np.int64)] = True
        passed = table[_slots(h1[outside], h2[outside], len(levels), bits).astype(np.int64)].all(axis=1)
        levels.append(table)
        inside, outside = outside[passed], inside
    return levels


def listed_in(levels: list[np.ndarray] | list[Bits], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: it fails first at an odd level or passes an odd number of all."""
    out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for k, table in enumerate(levels):
        passed = table[_slots(h1[open_], h2[open_], k, len(table)).astype(np.int64)].all(axis=1)
        out[open_[~passed]] = k % 2 == 1
        open_ = open_[passed]
    out[open_] = len(levels) % 2 == 1
    return out


def _pack(levels: list[np.ndarray]) -> bytes:
    return b"".join(len(t).to_bytes(8, "little") + np.packbits(t).tobytes() for t in levels)


class Bits:
    """A level's bit array, read where it lies packed."""

    def __init__(self, data: bytes, at: int, bits: int):
        self.bits, self.packed = bits, np.frombuffer(data, np.uint8, -(-bits // 8), at)

    def __len__(self) -> int:
        return self.bits

    def __getitem__(self, slots: np.ndarray) -> np.ndarray:
        return (self.packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


def _levels(data: bytes) -> list[Bits]:
    """The levels of a packed cascade; nothing is copied."""
    levels, at = [], 0
    while at < len(data):
        bits = int.from_bytes(data[at : at + 8], "little")
        levels.append(Bits(data, at + 8, bits))
        at += 8 + -(-bits // 8)
    return levels


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class UrlFilter:
    """Exact membership of keys in a list, over a universe of keys."""

    def __init__(self, universe: DataFrame, listed: DataFrame, *, shard_keys: int = SHARD_KEYS, max_bytes: int = MAX_BYTES, group_rows: int = GROUP_ROWS):
        """universe(key) and listed(key); repeats and nulls are ignored, as are listed keys outside the universe."""
        marked = universe.select("key", F.lit(False).alias("listed")).union(listed.select("key", F.lit(True).alias("listed"))).where("key is not null")
        keys = marked.groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_or(~F.col("listed")).alias("seen")).where("seen")
        keys = cut(keys.select("key", "listed", *_hashes(F.col("key"))))
        self.shards = max(1, -(-keys.count() // shard_keys))
        dealt = keys.withColumn("shard", F.pmod("h1", F.lit(self.shards)).cast("int")).repartition("shard").sortWithinPartitions("shard")

        def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                of = b.column("shard").to_numpy()
                edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if held and held[0].column("shard")[0] != b.column("shard")[lo]:
                        yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held)
                        held = []
                    held.append(b.slice(lo, hi - lo))
            if held:
                yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, t in shards_of(batches):
                h1, h2 = (t[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
                levels = build_cascade(h1, h2, t["listed"].to_numpy().astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(levels)], pa.binary())], ["shard", "levels"])

        self.built = cut(dealt.mapInArrow(build, "shard int, levels binary"))
        self.bytes = self.built.agg(F.sum(F.length("levels"))).first()[0] or 0
        self.group_rows = group_rows
        # Checked: at most max_bytes in all.
        self.cascades = {r.shard: bytes(r.levels) for r in self.built.toLocalIterator()} if self.bytes <= max_bytes else None

    def mark(self, rows: DataFrame, key_col: str, into: str) -> DataFrame:
        """rows with a boolean column; a null key is not listed."""
        if self.cascades is None:
            return self._sent(rows, key_col, into)
        sent, n = rows.sparkSession.sparkContext.broadcast(self.cascades), self.shards

        @F.pandas_udf("boolean")
        def member(h1, h2):  # noqa: ANN001, ANN202
            import pandas as pd

            a, b = h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)
            out, of = np.zeros(len(a), bool), np.mod(h1.to_numpy(), n)
            for k in np.unique(of):
                own = of == k
                out[own] = listed_in(_levels(sent.value.get(int(k), b"")), a[own], b[own])
            return pd.Series(out)

        return rows.withColumn(into, F.col(key_col).isNotNull() & member(*_hashes(F.col(key_col))))

    def _sent(self, rows: DataFrame, key_col: str, into: str) -> DataFrame:
        """mark() by sending rows to their shard's cascade, in groups of about group_rows."""
        shard = F.pmod(F.xxhash64(key_col), F.lit(self.shards)).cast("int")
        sizes = cut(rows.groupBy(shard.alias("shard")).agg(F.ceil(F.count("*") / self.group_rows).cast("int").alias("groups")))
        # One row of two numbers for each shard.
        dealt = (
            rows.withColumn("_shard", shard).join(F.broadcast(sizes.select(F.col("shard").alias("_of"), "groups")), F.col("_shard") == F.col("_of"))
            .withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.col("groups")).cast("int")).drop("_of", "groups")
            .withColumns({"_h1": F.xxhash64(key_col), "_h2": F.xxhash64(F.lit(1), key_col)})
        )
        copies = self.built.join(sizes, "shard").select(F.col("shard").alias("_shard"), "levels", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("_group"))

        def judge(own: pa.Table, cascade: pa.Table) -> pa.Table:
            h1, h2 = (own[c].to_numpy().view(np.uint64) for c in ("_h1", "_h2"))
            found = listed_in(_levels(cascade["levels"][0].as_py() if cascade.num_rows else b""), h1, h2)
            return own.select(names).append_column(into, pa.array(found & own[key_col].is_valid().to_numpy(zero_copy_only=False)))

        names = rows.columns
        keys = ["_shard", "_group"]
        schema = T.StructType([*rows.schema.fields, T.StructField(into, T.BooleanType())])
        return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(judge, schema)


def judge_urls(pages: DataFrame, blocked_hosts: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, **limits: int) -> DataFrame:
    """One row per page: id, host, path, rule, listed, verdict.

    blocked_hosts(key) is the block list. A rule decides before the list does. A
    null url or one without `://` has an empty host and path, which no rule fits; the
    empty host is listed only if the list has it. Repeated rows are judged alike.
    """
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    marked = UrlFilter(rows.select(F.col("host").alias("key")), blocked_hosts, **limits).mark(rows, "host", "listed")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return marked.select(id_col, "host", "path", rule.alias("rule"), "listed", F.coalesce(says, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def tracking_hosts(pages: DataFrame, url_col: str = "url", share: float = 1 / 6) -> DataFrame:
    """(key): hosts of whose urls at least the share carries a utm_ parameter."""
    rows = pages.select(host_of(F.col(url_col)).alias("key"), F.coalesce(F.col(url_col).contains("utm_"), F.lit(False)).cast("int").alias("t"))
    return rows.groupBy("key").agg(F.avg("t").alias("r")).where(F.col("r") >= share).select("key")
