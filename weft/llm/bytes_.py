"""Vectorised features of the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are looked at together; longer texts are taken in pieces of this size.
PIECE = 1 << 20
DOCS = 128

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most DOCS rows and about PIECE bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(a + DOCS, n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1))
        yield a, b
        a = b


def _language_bytes() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


_LETTERS = _language_bytes()


def gram_rows(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Letter unigrams and hashed letter trigrams: a unit row of 256 + dims for each text.

    A-Z is lower-cased, other ASCII becomes space, grams of two spaces or more are
    left out. A row is the square root of the shares of its grams.
    """
    n = len(offsets) - 1
    counts = np.zeros((n, 256 + dims), np.float64)
    base, end = int(offsets[0]), int(offsets[-1])
    for at in range(base, end, PIECE):
        stop = min(end, at + PIECE)
        x = _LETTERS[data[at : min(end, stop + 2)]].astype(np.uint32)
        doc = np.searchsorted(offsets, np.arange(at, at + len(x)), "right") - 1 if n > 1 else np.zeros(len(x), np.int64)
        own = stop - at
        letters = x[:own] != 32
        counts[:, :256] += np.bincount(doc[:own][letters] * 256 + x[:own][letters], minlength=n * 256).reshape(n, 256)
        if len(x) > 2:
            a, b, c = x[:-2], x[1:-1], x[2:]
            good = (doc[:-2] == doc[2:]) & ((a != 32) | (b != 32)) & ((b != 32) | (c != 32))
            h = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)) >> np.uint32(7)) % np.uint32(dims)
            counts[:, 256:] += np.bincount(doc[:-2][good] * dims + h[good].astype(np.int64), minlength=n * dims).reshape(n, dims)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def _classes() -> np.ndarray:
    """Sixteen kinds of bytes: spaces, letters, digits and groups of marks."""
    groups = {1: b"\n", 2: b"abcdefghijklmnopqrstuvwxyz", 3: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4: b"0123456789", 5: b".", 6: b",", 7: b"!?", 8: b"|", 9: b"$%&*#@^~", 10: b"\"'()[]{}<>", 11: b":/;", 12: b"-_=+"}
    table = np.full(256, 15, np.uint8)
    table[[32, 9, 11, 12, 13]] = 0
    for k, chars in groups.items():
        table[list(chars)] = k
    table[192:], table[128:192] = 13, 14
    return table


_KINDS = _classes()
_SALT = np.random.default_rng(3).integers(0, 1 << 32, 256)
PASSAGE_WORDS = 64
PASSAGE_DIMS = 256 + 128 + 5


def passage_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every passage of PASSAGE_WORDS words, and each text's number of them.

    A row has the square roots of the shares of pairs of byte kinds and of ASCII
    bytes, the share of words that begin in lower case, the mean word length, the
    passage's fullness, and the shares of distinct words and of words like the one
    before. A text without words is one passage.
    """
    base, n = int(offsets[0]), len(offsets) - 1
    x = data[base : int(offsets[-1])]
    lens = np.diff(offsets)
    doc = np.repeat(np.arange(n), lens)
    inside = ~SPACES[x]
    starts = inside.copy()
    if len(x):
        starts[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    seen = np.cumsum(starts)
    before = np.concatenate(([0], seen))[offsets[:-1] - base]
    words = np.concatenate(([0], seen))[offsets[1:] - base] - before
    n_passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.concatenate(([0], np.cumsum(n_passages)))
    of = first[doc] + np.maximum(seen - before[doc] - 1, 0) // PASSAGE_WORDS if len(x) else doc
    total = int(first[-1])
    kind = _KINDS[x].astype(np.int64)
    out = np.zeros((total, PASSAGE_DIMS), np.float32)
    size = np.maximum(np.bincount(of, minlength=total), 1)[:, None]
    if len(x) > 1:
        pair = (doc[1:] == doc[:-1])
        out[:, :256] = np.sqrt(np.bincount((of[:-1] * 256 + kind[:-1] * 16 + kind[1:])[pair], minlength=total * 256).reshape(total, 256) / size)
    ascii_ = x < 128
    out[:, 256:384] = np.sqrt(np.bincount((of * 128 + x)[ascii_], minlength=total * 128).reshape(total, 128) / size)
    n_words = np.maximum(np.bincount(of[starts], minlength=total), 1)
    low = np.bincount(of[starts & (kind == 2)], minlength=total)
    out[:, 384] = low / n_words
    out[:, 385] = np.minimum(np.bincount(of[inside], minlength=total) / n_words / 16, 4)
    out[:, 386] = n_words / PASSAGE_WORDS
    at = np.flatnonzero(starts)
    if len(at):
        word = np.add.reduceat(np.where(inside, _SALT[x], 0), at) & ((1 << 32) - 1)
        key = (of[at] << 32) | word
        out[:, 387] = np.bincount(np.unique(key) >> 32, minlength=total) / n_words
        out[:, 388] = np.bincount(of[at][1:][key[1:] == key[:-1]], minlength=total) / n_words
    return out, n_passages
