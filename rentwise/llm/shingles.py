"""Word shingles as 64-bit hashes, computed inside tasks from a text's UTF-8 bytes.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A
text's set holds its distinct shingles of five words; a shorter text has its
whole word sequence as its only shingle, and a text without words has none.

A shingle's hash is a polynomial over its bytes (words joined by one space), so
all of a text's hashes come from one running sum: the sum between two positions,
divided by the power of the first.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
AT_ONCE = 200_000  # words hashed at once; longer texts go in overlapping parts

_SPACES = [32, 9, 10, 11, 12, 13]


class Hasher:
    """Tables of the polynomial hash; the powers grow with the longest part seen."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.fold[_SPACES] = 32
        self.value = np.random.default_rng(5).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._grow(1 << 16)

    def _grow(self, size: int):
        def powers(base):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base)
            return np.cumprod(out)

        self.power, self.inverse = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))

    def shingles(self, text: bytes | None, words: int = WORDS) -> np.ndarray:
        """Sorted distinct shingle hashes (uint64) of one text; null counts as empty."""
        empty = np.empty(0, np.uint64)
        if not text:
            return empty
        folded = self.fold[np.frombuffer(text, np.uint8)]
        gap = folded == 32
        twice = gap[1:] & gap[:-1]
        if gap[0] or twice.any():  # one space between words, none in front
            drop = np.r_[gap[0], twice]
            folded = folded[~drop]
            gap = folded == 32
        ends = np.flatnonzero(gap)
        if len(folded) and not gap[-1]:
            ends = np.r_[ends, len(folded)]
        if not len(ends):
            return empty
        starts = np.r_[0, ends[:-1] + 1]
        k = min(words, len(ends))
        parts = []
        for at in range(0, len(ends) - k + 1, AT_ONCE):
            first, last = starts[at:at + AT_ONCE][:len(ends) - k + 1 - at], ends[at + k - 1:at + k - 1 + AT_ONCE]
            base = first[0]
            piece = folded[base:last[-1]]
            if len(piece) >= len(self.power):
                self._grow(2 * len(piece))
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(self.value[piece] * self.power[:len(piece)], out=total[1:])
            first, last = first - base, last - base
            parts.append((total[last] - total[first]) * self.inverse[first])
        h = parts[0] if len(parts) == 1 else np.concatenate(parts)
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = np.sort(h ^ (h >> np.uint64(29)))
        return h if len(h) < 2 else h[np.r_[True, h[1:] != h[:-1]]]
