"""Places of pattern matches in batches of texts, by numpy inside tasks.

The texts of a batch are joined by a character that no pattern matches, and a pattern
goes over the whole once: a text costs its length and its matches, not a call a pattern.
"""

from __future__ import annotations

import re

import numpy as np

GAP = "\x00"


class Joined:
    """Texts as one; `starts` are their places in it."""

    def __init__(self, texts: list[str]):
        self.whole = GAP.join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(sizes + 1) - sizes - 1

    def matches(self, pattern: str) -> tuple[np.ndarray, np.ndarray, list[re.Match]]:
        """(starts, ends, matches) in the whole, in order. Classes such as \\b are those of ASCII."""
        found = [*re.finditer(pattern, self.whole, re.ASCII)]
        spans = np.array([m.span() for m in found], np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1], found

    def row(self, at: np.ndarray) -> np.ndarray:
        """The text that a place lies in."""
        return np.searchsorted(self.starts, at, side="right") - 1


def inside(starts: np.ndarray, ends: np.ndarray, outer: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which spans lie within one of the outer spans, which are in order and do not overlap."""
    last = np.searchsorted(outer[0], starts, side="right") - 1
    return (last >= 0) & (ends <= np.append(outer[1], -1)[last])


def nearest(joined: Joined, patterns: list[str], row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """For anchors in texts `row` the rank of the pattern with the nearest match, the first of tied ones; -1 if there is none.

    A match that holds the anchor is at 0. Of a pattern's matches only those next to the anchor count.
    """
    far = np.iinfo(np.int64).max
    base = joined.starts[row]
    end = np.append(joined.starts[1:], len(joined.whole) + 1)[row]
    at = base + anchor
    least, rank = np.full(len(row), far), np.full(len(row), -1, np.int64)
    for k, p in enumerate(patterns):
        s, e, _ = joined.matches(p)
        if not len(s):
            continue
        after = np.searchsorted(s, at, side="right")
        left, right = np.maximum(after - 1, 0), np.minimum(after, len(s) - 1)
        d = np.minimum(
            np.where((after > 0) & (s[left] >= base), np.maximum(at - e[left], 0), far),
            np.where((after < len(s)) & (s[right] < end), s[right] - at, far),
        )
        rank = np.where(d < least, k, rank)
        least = np.minimum(d, least)
    return rank
