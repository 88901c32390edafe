"""Hashed character n-grams of texts, in numpy."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
#: Code points of a text hashed at once: longer texts go through in overlapping blocks.
BLOCK = 1 << 20


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, other ASCII than letters as spaces, runs of spaces kept."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_other = (points < 128) & ((points < 97) | (points > 122))
    return np.where(ascii_other, np.uint32(32), points)


def hashed(points: np.ndarray, lengths: tuple[int, ...], bits: int) -> np.ndarray:
    """One bucket below 2**bits for each n-gram of each length, in order of lengths."""
    out = []
    wide = points.astype(np.uint64) + np.uint64(1)
    running = wide
    for n in range(1, max(lengths) + 1):
        if n > 1:
            if len(wide) < n:
                break
            running = running[:-1] * _STEP + wide[n - 1 :]
        if n in lengths:
            out.append((((running + np.uint64(n)) * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def blocks(text: str, longest: int) -> list[np.ndarray]:
    """The text's code points, in blocks that share ``longest - 1`` points so that no n-gram is lost.
    N-grams shorter than the longest that lie in a shared part come twice; sets don't mind, and
    counts get at most a few more per million."""
    points = code_points(text)
    if len(points) <= BLOCK:
        return [points]
    return [points[i : i + BLOCK + longest - 1] for i in range(0, len(points) - longest + 1, BLOCK)]


class Presence:
    """The set of buckets of one text; the scratch array is reused from text to text."""

    def __init__(self, lengths: tuple[int, ...], bits: int):
        self.lengths, self.bits = lengths, bits
        self._seen = np.zeros(1 << bits, np.bool_)

    def __call__(self, text: str) -> np.ndarray:
        for points in blocks(text, max(self.lengths)):
            self._seen[hashed(points, self.lengths, self.bits)] = True
        found = np.flatnonzero(self._seen)
        self._seen[found] = False
        return found
