"""LM scoring with Elias-Fano n-gram tries of order 3.

Training counts every bigram and trigram of all training texts; nothing is pruned.
Tasks count runs of about FLUSH tokens in numpy and send each shard its share of the
counts; a shard's task adds them up and writes its trie, one file of levels, to the
shared folder. The driver gets one row of numbers for each shard. A shard is a range
of hashes of an n-gram's first word and one of SPLIT ranges of hashes of its
second, so that the bigrams of a word that a large part of all tokens follow are
dealt over SPLIT tasks. The first of a range's shards has all its words with their
counts.

A shard's levels are
  words      Elias-Fano sequence of first words' hashes, with exact counts and the
             sum of what their successors here take;
  pointers   Elias-Fano sequence of where each word's successors begin;
  successors Elias-Fano sequence of second words, numbered relative to their context:
             a context with successors b to e has the numbers from b * 2^R to
             e * 2^R, over which the bits of a successor's hash are scaled, so that
             numbers are even whether a context has one successor or a million;
             each has two bytes of quantised probability and two of what its
             own successors leave;
  pointers3  Elias-Fano sequence of where each bigram's successors begin;
  thirds     third words, numbered likewise, each with one byte of quantised
             probability.
A trigram is found by the first word's place, the two pointers there, one search for
the second word's number, the two pointers there and one search for the third's.

p(w | v) = share(v, w) + left(v) p(w) and p(w | u, v) = share(u, v, w) + left(u, v)
p(w | v): share is the count less DISCOUNT over the context's count, rounded down to a
quantised value; left is what the shares leave; p(w) = (c(w) + 1) / (N + V + 1). So
every context's probabilities add up to one, the unknown word included, less at most
2^-16 where left is rounded down. A text's first word has the end of a text as
context, and no trigram.

Words are told apart by 64-bit hashes (two of V words agree with a probability of
V^2 / 2^65), second words after a context by 40 bits of them and third words by 32.
An n-gram that did not occur is taken for one that did with a probability of about
2^-R for each search, R being 24 for bigrams and 20 for trigrams.

Scorers take a batch of about STEP tokens at a time, sort its n-grams, and map the
shards that have some of them one after the other, so that no more than one file is
open. A shard whose file is missing or has another size is an error.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.bytes_ import PIECE, SPACES, flat, pieces
from weft.llm.common import crc_of, cut, qualified, shared_dir

DISCOUNT = 0.75
FLUSH = 2_000_000
STEP = 1 << 20
SHARD_BYTES = 24 << 20
#: Bits of a successor's hash, and of its number relative to its context (R), for second and third words.
BITS, BITS3 = 40, 32
R, R3 = 24, 20
SPLIT_BITS = 2
SPLIT = 1 << SPLIT_BITS
END = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(17).integers(0, 1 << 64, (64, 256), dtype=np.uint64)
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_hashes(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and each text's number of words.

    x has the texts' bytes, text i those from offsets[i] to offsets[i + 1]. Bytes are
    hashed by tabulation of their place in the word.
    """
    n = len(offsets) - 1
    if not len(x):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    x = _LOWER[x]
    inside = ~SPACES[x]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(x)]
    starts[edges] = inside[edges]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    count = np.cumsum(starts)
    place = np.arange(len(x)) - at[np.maximum(count - 1, 0)]
    t = np.where(inside, _TABLE[place & 63, x], _U(0))
    far = inside & (place >= 64)
    if far.any():
        t[far] *= np.power(_U(0x2545F4914F6CDD1D), (place[far] >> 6).astype(np.uint64))
    seen = np.concatenate(([0], count))
    return _mixed(np.add.reduceat(t, at)), seen[offsets[1:]] - seen[offsets[:-1]]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and ends of some texts, and each text's number of tokens. A long text is hashed in pieces."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi - lo <= 2 * PIECE or len(offsets) > 2:
        h, n = word_hashes(data[lo:hi], offsets - lo)
    else:
        parts, at = [], lo
        while at < hi:
            stop = min(hi, at + PIECE)
            while stop < hi and not SPACES[data[stop]]:
                stop += 1
            parts.append(word_hashes(data[at:stop], np.array([0, stop - at]))[0])
            at = stop
        h = np.concatenate(parts)
        n = np.array([len(h)])
    return np.insert(h, np.cumsum(n), END), n + 1


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of unsigned keys below 2^bits; the keys are given up."""
    own = len(key).bit_length()
    if bits + own > 64:
        order = np.argsort(key, kind="stable")
        return order.astype(np.int32), key[order]
    # Key and place in one number, which sorts faster than places by key; in place, since runs are long.
    key <<= _U(own)
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    order = (key & _U((1 << own) - 1)).astype(np.int32)
    key >>= _U(own)
    return order, key


def _distinct(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, place of each key among them, counts); the keys are given up."""
    if not len(key):
        return key, np.empty(0, np.int32), np.empty(0, np.int32)
    order, s = _sorted(key, bits)
    new = np.append(True, s[1:] != s[:-1])
    inverse = np.empty(len(key), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    at = np.flatnonzero(new).astype(np.int32)
    return s[at], inverse, np.diff(np.append(at, np.int32(len(key))))


def _distinct_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes in order, place of each hash among them)."""
    own = _U(len(h).bit_length())
    key = (h >> own) << own
    key |= np.arange(len(h), dtype=np.uint64)
    key.sort()
    order = (key & _U((1 << int(own)) - 1)).astype(np.int32)
    s = np.take(h, order, out=key)
    if (s[1:] < s[:-1]).any():
        words, inverse = np.unique(h, return_inverse=True)
        return words, inverse.astype(np.int32)
    new = np.append(True, s[1:] != s[:-1])
    inverse = np.empty(len(h), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return s[new], inverse


class Grams:
    """The n-grams of a stretch of tokens that two tokens go before.

    words are distinct hashes; pairs are distinct bigrams a * len(words) + b, and pair
    has each token's, that of the token before the stretch first; thirds are distinct
    trigrams pair * len(words) + word, for `tri`, the tokens that do not begin a text.
    """

    def __init__(self, seq: np.ndarray):
        self.words, self.of = _distinct_hashes(seq)
        w = _U(len(self.words))
        key = self.of[:-1].astype(np.uint64)
        key *= w
        key += self.of[1:].astype(np.uint64)
        pairs, self.pair, self.n_pair = _distinct(key, 2 * len(self.words).bit_length())
        self.a, self.b = (pairs // w).astype(np.int32), (pairs % w).astype(np.int32)
        self.tri = seq[1:-1] != END
        key = self.pair[:-1][self.tri].astype(np.uint64)
        key *= w
        key += self.of[2:][self.tri].astype(np.uint64)
        thirds, self.third, self.n_third = _distinct(key, len(pairs).bit_length() + len(self.words).bit_length())
        del key
        self.context, self.c = (thirds // w).astype(np.int32), (thirds % w).astype(np.int32)


class EliasFano:
    """A monotone sequence of numbers: low bits packed, high bits in unary."""

    def __init__(self, n: int, low: int, high: np.ndarray, zeros: np.ndarray, lows: np.ndarray):
        self.n, self.low, self.high, self.zeros, self.lows = n, low, high, zeros, lows
        self.ones: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low = max(0, (universe // max(n, 1)).bit_length() - 1)
        top = (values >> _U(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64)
        size = n + (universe >> low) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = bits.reshape(-1, 64).sum(axis=1)
        zeros = np.concatenate(([0], np.cumsum(64 - ones)[:-1])).astype(np.int64 if size >> 31 else np.int32)
        packed = []
        for at in range(0, n if low else 0, 1 << 16):
            b = np.unpackbits(np.ascontiguousarray(values[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low]
            packed.append(np.packbits(b.ravel(), bitorder="little"))
        raw = np.concatenate([*packed, np.zeros(16, np.uint8)])
        return cls(n, low, high, zeros, np.concatenate((raw, np.zeros(-len(raw) % 8, np.uint8))).view(np.uint64))

    def lows_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        w, s = bit >> 6, (bit & 63).astype(np.uint64)
        upper = np.where(s > 0, self.lows[w + 1] << ((_U(64) - s) & _U(63)), _U(0))
        return ((self.lows[w] >> s) | upper) & _U((1 << self.low) - 1)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Place of the k-th bit of a kind, from 0; before counts them before each word."""
        w = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        r, x = k - before[w], self.high[w] ^ _U(flip)
        out = w.astype(np.int64) * 64
        for half in (32, 16, 8, 4, 2, 1):
            part = x & _U((1 << half) - 1)
            c = np.bitwise_count(part).astype(np.int64)
            up = r >= c
            r = np.where(up, r - c, r)
            out += np.where(up, half, 0)
            x = np.where(up, x >> _U(half), part)
        return out

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values by place."""
        if self.ones is None:
            self.ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        top = self._select(i, self.ones, 0) - i
        return (top.astype(np.uint64) << _U(self.low)) | self.lows_at(i)

    def place_of(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 if it is not in the sequence."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        top = (values >> _U(self.low)).astype(np.int64)
        want = values & _U((1 << self.low) - 1)
        bit = np.where(top > 0, self._select(np.maximum(top - 1, 0), self.zeros, 0xFFFFFFFFFFFFFFFF) + 1, 0)
        live = np.arange(len(values))
        while len(live):
            live = live[(self.high[bit[live] >> 6] >> (bit[live] & 63).astype(np.uint64)) & _U(1) == 1]
            if not len(live):
                break
            i = bit[live] - top[live]
            low = self.lows_at(i)
            found = low == want[live]
            out[live[found]] = i[found]
            live = live[low < want[live]]
            bit[live] += 1
        return out


def _quantised(p: np.ndarray, kind: type) -> tuple[np.ndarray, float]:
    """(codes, least log10): code k of a kind with K + 1 codes is 10^(least * (1 - k / K)), never above p."""
    top = np.iinfo(kind).max
    logs = np.log10(p)
    least = min(float(logs.min()) if len(p) else 0.0, -1e-9)
    return np.floor((1 - logs / least) * top + 1e-9).clip(0, top).astype(kind), least


def _value(codes: np.ndarray, least: float) -> np.ndarray:
    return 10.0 ** (least * (1 - codes / np.iinfo(codes.dtype).max))


def _relative(begin: np.ndarray, end: np.ndarray, successor: np.ndarray, bits: int, r: int, cut_off: int) -> np.ndarray:
    """Numbers of successors, hashes of `bits` bits, of contexts whose successors have places begin to end.

    cut_off low bits of the hashes are left out, so that products stay within 64 bits.
    """
    return (begin << _U(r)) + (((successor >> _U(cut_off)) * (end - begin)) >> _U(bits - cut_off - r))


def _cut_off(most: int, bits: int) -> int:
    return max(0, most.bit_length() + bits - 64)


def _book(share: np.ndarray, common: int = 191, steps: int = 64) -> np.ndarray:
    """At most 256 values that stand for shares: the most frequent ones, and even steps of the logarithm."""
    s = np.sort(share)
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
    if len(at) <= 1 + common + steps:
        return s[at]
    often = np.argsort(-np.diff(np.append(at, len(s))), kind="stable")[:common]
    return np.unique(np.concatenate((s[:1], s[at[often]], np.geomspace(s[0], s[-1], steps))))


_LEVELS = ("words", "pointers", "successors", "pointers3", "thirds")


class Trie:
    """The levels of one shard: built from counts, or mapped from a file."""

    def __init__(self, meta: dict, arrays: dict[str, np.ndarray]):
        self.meta, self.arrays = meta, arrays
        self.words, self.pointers, self.successors, self.pointers3, self.thirds = (
            EliasFano(*meta[k], *(arrays[f"{k}.{part}"] for part in ("high", "zeros", "lows"))) for k in _LEVELS
        )

    @classmethod
    def build(cls, words: np.ndarray, total: np.ndarray, runs: np.ndarray, successor: np.ndarray, count: np.ndarray, runs3: np.ndarray, third: np.ndarray, count3: np.ndarray, shard_bits: int, first: bool, discount: float) -> Trie:
        """From words and their counts, each word's number of bigrams, their second words
        and counts, each bigram's number of trigrams, their third words and counts.

        Words, bigrams and trigrams may repeat and are added up. The first shard of a
        range keeps all words, the others those with successors.
        """
        words, own = np.unique(words, return_inverse=True)
        total = np.bincount(own, total, len(words)).astype(np.int64)
        node = np.repeat(own, runs)
        if len(words) >> (64 - BITS):
            order = np.lexsort((successor, node))
        else:
            order = np.argsort((node.astype(np.uint64) << _U(BITS)) | successor)
        node, successor, count = node[order], successor[order], count[order]
        new = np.append(True, (node[1:] != node[:-1]) | (successor[1:] != successor[:-1])) if len(order) else np.empty(0, bool)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        node, successor, count = node[at], successor[at], np.add.reduceat(count, at) if len(at) else count
        if not first:
            used, node = np.unique(node, return_inverse=True)
            words, total = words[used], np.empty(0, np.int64)
        key = (np.repeat(of, runs3).astype(np.uint64) << _U(BITS3)) | third
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        count3 = np.add.reduceat(count3[order], at) if len(at) else count3
        context, third = (key[at] >> _U(BITS3)).astype(np.int64), key[at] & _U((1 << BITS3) - 1)

        taken = count - discount
        most = float(taken.max()) if len(taken) else 1.0
        codes, least = _quantised(taken / most, np.uint16)
        share = (count3 - discount) / np.bincount(context, count3, len(node))[context]
        book = _book(share)
        codes3 = np.maximum(np.searchsorted(book, share, "right") - 1, 0).astype(np.uint8)
        left = 1 - np.bincount(context, book[codes3] if len(book) else share, len(node))
        begin = np.searchsorted(node, np.arange(len(words) + 1)).astype(np.uint64)
        begin3 = np.searchsorted(context, np.arange(len(node) + 1)).astype(np.uint64)
        offs = [_cut_off(int(np.diff(x).max()) if len(x) > 1 else 0, n) for x, n in ((begin, BITS), (begin3, BITS3))]
        levels = {
            "words": EliasFano.build(words & _U((1 << (64 - shard_bits)) - 1), 1 << (64 - shard_bits)),
            "pointers": EliasFano.build(begin, len(node) + 1),
            "successors": EliasFano.build(_relative(begin[node], begin[node + 1], successor, BITS, R, offs[0]), max(1, len(node)) << R),
            "pointers3": EliasFano.build(begin3, len(context) + 1),
            "thirds": EliasFano.build(_relative(begin3[context], begin3[context + 1], third, BITS3, R3, offs[1]), max(1, len(context)) << R3),
        }
        meta = {k: [e.n, e.low] for k, e in levels.items()} | {"least": least, "most": most, "shard_bits": shard_bits, "cut_off": offs}
        arrays = {f"{k}.{part}": getattr(e, part) for k, e in levels.items() for part in ("high", "zeros", "lows")}
        small = total.astype(np.uint32) if not len(total) or total.max() < 1 << 32 else total.astype(np.uint64)
        more = {"count": small, "taken": codes, "mass": np.bincount(node, most * _value(codes, least), len(words)).astype(np.float32)}
        return cls(meta, arrays | more | {"left": np.floor(left.clip(0, 1) * 65535 + 1e-6).astype(np.uint16), "share": codes3, "book": book})

    def pack(self) -> bytes:
        place, parts, at = {}, [], 0
        for k, a in self.arrays.items():
            body = a.tobytes()
            place[k] = [a.dtype.str, len(a), at]
            parts.append(body + b"\0" * (-len(body) % 8))
            at += len(parts[-1])
        head = json.dumps({"meta": self.meta, "place": place}).encode()
        head += b" " * (-len(head) % 8)
        return len(head).to_bytes(8, "little") + head + b"".join(parts)

    @classmethod
    def load(cls, data: bytes | mmap.mmap) -> Trie:
        size = int.from_bytes(data[:8], "little")
        head = json.loads(data[8 : 8 + size])
        return cls(head["meta"], {k: np.frombuffer(data, kind, n, 8 + size + at) for k, (kind, n, at) in head["place"].items()})

    def place_of(self, words: np.ndarray) -> np.ndarray:
        return self.words.place_of(words & _U((1 << (64 - self.meta["shard_bits"])) - 1))

    def counts(self, place: np.ndarray) -> np.ndarray:
        """Of words by place, 0 where there is none; only the first shard of a range has them."""
        return np.where(place >= 0, self.arrays["count"][np.maximum(place, 0)], 0) if len(self.arrays["count"]) else np.zeros(len(place), np.int64)

    def mass(self, place: np.ndarray) -> np.ndarray:
        """What a context's successors here take, in counts."""
        return np.where(place >= 0, self.arrays["mass"][np.maximum(place, 0)], 0.0) if self.words.n else np.zeros(len(place))

    def second(self, place: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Places of bigrams given by their first word's place; -1 for those that are not there."""
        out = np.full(len(place), -1, np.int64)
        ok = np.flatnonzero(place >= 0)
        if not len(ok) or not self.successors.n:
            return out
        begin, end = self.pointers.at(place[ok]), self.pointers.at(place[ok] + 1)
        ok, begin, end = ok[end > begin], begin[end > begin], end[end > begin]
        i = self.successors.place_of(_relative(begin, end, successor[ok], BITS, R, self.meta["cut_off"][0]))
        hit = (i >= begin.astype(np.int64)) & (i < end.astype(np.int64))
        out[ok[hit]] = i[hit]
        return out

    def taken(self, bigram: np.ndarray) -> np.ndarray:
        """Discounted counts of bigrams by place."""
        return self.meta["most"] * _value(self.arrays["taken"][bigram], self.meta["least"])

    def left(self, bigram: np.ndarray) -> np.ndarray:
        """What the successors of bigrams leave."""
        return self.arrays["left"][bigram] / 65535

    def third(self, begin: np.ndarray, end: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Shares of trigrams whose bigram's successors have places begin to end; 0 for those that are not there."""
        out = np.zeros(len(begin))
        i = self.thirds.place_of(_relative(begin, end, successor, BITS3, R3, self.meta["cut_off"][1]))
        hit = np.flatnonzero((i >= begin.astype(np.int64)) & (i < end.astype(np.int64)))
        out[hit] = self.arrays["book"][self.arrays["share"][i[hit]]]
        return out


def _packed(x: np.ndarray) -> tuple[int, bytes]:
    """Counts in the fewest bytes, and how many."""
    size = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return size, x.astype(f"u{size}").tobytes()


def _blobs(seq: np.ndarray, shard_bits: int) -> Iterator[tuple[int, bytes]]:
    """(shard, counts) of the n-grams of a stretch of tokens that two tokens go before."""
    g = Grams(seq)
    words, count = g.words, g.n_pair
    count[g.pair[0]] -= 1
    del g.of, g.pair, g.third
    runs3 = np.bincount(g.context, minlength=len(count))
    total = np.bincount(g.a, count, len(words)).astype(np.uint32)
    second, third = (words[x].view(np.uint8).reshape(-1, 8)[:, : n // 8] for x, n in ((g.b, BITS), (g.c, BITS3)))
    edges = np.append(np.searchsorted(words >> _U(64 - shard_bits), np.arange(1 << shard_bits, dtype=np.uint64)), len(words))
    side = (words >> _U(64 - SPLIT_BITS)).astype(np.int8)[g.b]
    there = (count > 0) | (runs3 > 0)
    for j in range(SPLIT):
        own = np.flatnonzero(there & (side == j))
        n, c, low, r3 = g.a[own], count[own], second[own], runs3[own]
        own3 = np.flatnonzero((side == j)[g.context])
        c3, low3 = g.n_third[own3], third[own3]
        first, first3 = np.searchsorted(n, np.arange(len(words) + 1)), np.append(0, np.cumsum(r3))
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            runs = np.diff(first[a : b + 1])
            here = np.full(b - a, j == 0) | (runs > 0)
            if here.any():
                lo, hi = first[a], first[b]
                lo3, hi3 = first3[lo], first3[hi]
                counts = total[a:b][here] if j == 0 else np.empty(0, np.uint32)
                sized = [_packed(x) for x in (counts, runs[here], c[lo:hi], r3[lo:hi], c3[lo3:hi3])]
                head = np.array([here.sum(), len(counts), hi - lo, hi3 - lo3, *[k for k, _ in sized]], np.int64)
                yield i * SPLIT + j, b"".join((head.tobytes(), words[a:b][here].tobytes(), *[x for _, x in sized], low[lo:hi].tobytes(), low3[lo3:hi3].tobytes()))


def _unblob(data: bytes) -> tuple[np.ndarray, ...]:
    """Words, their counts and numbers of bigrams; bigrams' second words, counts and numbers of trigrams; third words and counts."""
    n, m0, m, m3, *sizes = np.frombuffer(data, np.int64, 9).tolist()
    words = np.frombuffer(data, np.uint64, n, 72)
    at, parts = 72 + 8 * n, []
    for k, size in zip((m0, n, m, m, m3), sizes, strict=True):
        parts.append(np.frombuffer(data, f"u{size}", k, at).astype(np.int64))
        at += k * size
    hashes = []
    for k, bits in ((m, BITS), (m3, BITS3)):
        low = np.zeros((k, 8), np.uint8)
        low[:, : bits // 8] = np.frombuffer(data, np.uint8, k * (bits // 8), at).reshape(k, bits // 8)
        hashes.append(low.view(np.uint64).ravel())
        at += k * (bits // 8)
    total, runs, count, runs3, count3 = parts
    return words, total if m0 else np.zeros(n, np.int64), runs, hashes[0], count, runs3, hashes[1], count3


def _stretches(tok: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Whole texts' tokens in stretches of about `size`, each with the two tokens before it."""
    n = max(1, len(tok) // size)
    for k in range(n):
        a, b = len(tok) * k // n, len(tok) * (k + 1) // n
        yield np.concatenate((tok[a - 2 : a] if a >= 2 else np.append([END, END], tok[:a])[-2:].astype(np.uint64), tok[a:b]))


class LanguageModel:
    """A trained model: its totals and where its shards' files are."""

    def __init__(self, docs: DataFrame, text_col: str = "text", *, discount: float = DISCOUNT, shard_bytes: int = SHARD_BYTES, flush: int = FLUSH):
        spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        # Ranges of contexts; SPLIT shards of about shard_bytes each.
        self.shard_bits = bits = max(1, int(-(-size // (shard_bytes * SPLIT))).bit_length())
        folder = qualified(spark, shared_dir(spark).rstrip("/") + f"/lm-{uuid.uuid4().hex}")
        # A folder of files that every machine mounts, or a store that only Spark reads.
        self.folder = local = folder[5:] if folder.startswith("file:") else None

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def flushed() -> Iterator[pa.RecordBatch]:
                tok = np.concatenate(held)
                held.clear()
                for seq in _stretches(tok, flush):
                    for k, blob in _blobs(seq, bits):
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["shard", "counts"])

            for b in batches:
                data, offsets = flat(b.column(0))
                for lo, hi in pieces(offsets):
                    held.append(tokens(data, offsets[lo : hi + 1])[0])
                    n += len(held[-1])
                    if n >= flush:
                        yield from flushed()
                        n = 0
            if held:
                yield from flushed()

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if k not in held and held:
                        yield written(*held.popitem())
                    held.setdefault(k, []).append(_unblob(blob.as_py()))
            while held:
                yield written(*held.popitem())

        def written(k: int, parts: list) -> pa.RecordBatch:
            joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts.clear()
            trie = Trie.build(*joined, bits, k % SPLIT == 0, discount)
            packed = trie.pack()
            if local is not None:
                os.makedirs(local, exist_ok=True)
                # A retried task replaces the file by an equal one.
                own = f"{local}/{k}.{uuid.uuid4().hex}"
                with open(own, "wb") as f:
                    f.write(packed)
                os.replace(own, f"{local}/{k}.trie")
            c = trie.arrays["count"]
            row = [[k], [int(c.sum())], [len(c)], [trie.successors.n], [trie.thirds.n], [len(packed)], [None if local is not None else packed]]
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names)

        names = ["shard", "n", "words", "bigrams", "trigrams", "bytes", "levels"]
        counts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "shard int, counts binary")
        dealt = counts.repartition(SPLIT << bits, "shard").sortWithinPartitions("shard")
        built = dealt.mapInArrow(build, "shard int, n long, words long, bigrams long, trigrams long, bytes long, levels binary")
        self.files: list[str] = []
        if local is None:
            # Executors fetch the table's files, and so need room for the whole model.
            built.write.parquet(folder)
            built = spark.read.parquet(folder)
            for f in built.inputFiles():
                spark.sparkContext.addFile(f)
                self.files.append(f.rpartition("/")[2])
        else:
            built = cut(built)
        # A row of numbers for each shard.
        rows = built.drop("levels").toArrow().to_pydict()
        self.n, self.v, self.bigrams, self.trigrams, self.bytes = (sum(rows[k]) for k in names[1:-1])
        self.sizes = dict(zip(rows["shard"], rows["bytes"], strict=True))

    def open(self) -> Callable[[int], Trie | None]:
        """Maps shards into this process's memory, by number; None for one without n-grams."""
        folder, held = self.folder, None
        if folder is None:
            import pyarrow.parquet as pq
            from pyspark import SparkFiles

            held = tempfile.TemporaryDirectory()
            folder = held.name
            for name in self.files:
                for b in pq.ParquetFile(SparkFiles.get(name)).iter_batches(1, columns=["shard", "levels"]):
                    with open(f"{folder}/{b.column(0)[0].as_py()}.trie", "wb") as f:
                        f.write(b.column(1)[0].as_buffer())

        def get(k: int, _held: object = held) -> Trie | None:
            if k not in self.sizes:
                return None
            with open(f"{folder}/{k}.trie", "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            if len(data) != self.sizes[k]:
                raise OSError(f"shard {k} of the model has {len(data)} bytes instead of {self.sizes[k]}")
            return Trie.load(data)

        return get

    def look_up(self, get: Callable[[int], Trie | None], seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, log10 probability) of tokens that two tokens go before. Equal n-grams are looked up once."""
        g = Grams(seq)
        words, a, b = g.words, g.a, g.b
        count, mass = np.zeros(len(words), np.int64), np.zeros(len(words))
        taken, left, share = np.zeros(len(a)), np.ones(len(a)), np.zeros(len(g.c))
        edges = np.append(np.searchsorted(words >> _U(64 - self.shard_bits), np.arange(1 << self.shard_bits, dtype=np.uint64)), len(words))
        cuts, side = np.searchsorted(a, edges), (words >> _U(64 - SPLIT_BITS)).astype(np.int64)[b]
        starts = np.searchsorted(g.context, np.arange(len(a) + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[i], edges[i + 1]
            for j in range(SPLIT):
                t = get(i * SPLIT + j)
                if t is None:
                    continue
                place = t.place_of(words[lo:hi])
                mass[lo:hi] += t.mass(place)
                if j == 0:
                    count[lo:hi] = t.counts(place)
                own = cuts[i] + np.flatnonzero(side[cuts[i] : cuts[i + 1]] == j)
                at = t.second(place[a[own] - lo], words[b[own]] & _U((1 << BITS) - 1))
                own, at = own[at >= 0], at[at >= 0]
                taken[own], left[own] = t.taken(at), t.left(at)
                # Trigrams of these bigrams, in the order of the level.
                own, at = own[starts[own + 1] > starts[own]], at[starts[own + 1] > starts[own]]
                begin, end = t.pointers3.at(at), t.pointers3.at(at + 1)
                own, begin, end = own[end > begin], begin[end > begin], end[end > begin]
                n = starts[own + 1] - starts[own]
                which = np.repeat(starts[own] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
                share[which] = t.third(np.repeat(begin, n), np.repeat(end, n), words[g.c[which]] & _U((1 << BITS3) - 1))
        seen = np.maximum(count, 1)
        p2 = taken / seen[a] + np.where(count > 0, 1 - mass / seen, 1.0)[a] * (count[b] + 1) / (self.n + self.v + 1)
        p = p2[g.pair[1:]]
        p[g.tri] = share[g.third] + left[g.pair[:-1][g.tri]] * p[g.tri]
        return count[g.of[2:]], np.log10(p)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per input row: id, n_tokens, n_known, base_score, score.

        A null or empty text is one token, the end.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = self.open()
            for b in batches:
                data, offsets = flat(b.column(1))
                n, known = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                base, score = np.zeros(b.num_rows), np.zeros(b.num_rows)
                held: list[np.ndarray] = []
                first = 0
                for lo, hi in pieces(offsets):
                    tok, n[lo:hi] = tokens(data, offsets[lo : hi + 1])
                    held.append(tok)
                    if hi < b.num_rows and sum(map(len, held)) < STEP:
                        continue
                    # Whole texts of about STEP tokens, looked up together.
                    got = [self.look_up(get, seq) for seq in _stretches(np.concatenate(held), STEP)]
                    c, p = (np.concatenate(x) for x in zip(*got, strict=True))
                    at = np.concatenate(([0], np.cumsum(n[first:hi])[:-1]))
                    known[first:hi] = np.add.reduceat((c > 0).astype(np.int64), at)
                    base[first:hi] = np.add.reduceat(np.log10((c + 1) / (self.n + self.v + 1)), at)
                    score[first:hi] = np.add.reduceat(p, at)
                    held, first = [], hi
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n, known, base, score))], ["id", "n_tokens", "n_known", "base_score", "score"])

        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
        kind = docs.schema[id_col].dataType.simpleString()
        return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 7, held_out: int = 2) -> DataFrame:
    """Scores of all docs by a model of those whose crc32(id) mod folds is not held_out.

    Adds held_out and train_tokens. Repeated rows count as often as they occur and are
    scored alike. With no training row, every token is unknown and score equals
    base_score; an empty table gives no rows.
    """
    out = F.pmod(crc_of(id_col), F.lit(folds)) == held_out
    model = LanguageModel(docs.where(~out), text_col)
    return model.score(docs, id_col, text_col).select(id_col, out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
