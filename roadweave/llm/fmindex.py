"""A compressed full-text index in numpy: wavelet matrix over a Burrows-Wheeler transform.

Suffixes are sorted by their first `depth` symbols only, which is all that
backward search needs for patterns of up to `depth` symbols.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32)
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at].astype(np.int64) + np.bitwise_count(self.words[at] & mask)


class FMIndex:
    """text: symbols 0 (separator, also last) to sigma - 1."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        padded = np.concatenate([text, np.zeros(depth, text.dtype)])
        self.suffixes = np.lexsort([padded[d : d + n] for d in range(depth - 1, -1, -1)])
        self.sigma = int(text.max(initial=0)) + 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        symbols, self.levels = text[self.suffixes - 1], []
        for b in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> b & 1).astype(bool)
            self.levels.append((b, Bits(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        every = np.arange(self.sigma)
        self.first = self._down(every, np.zeros(self.sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, bits in self.levels:
            ones = bits.rank(i)
            i = np.where(c >> b & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol c among the first i of the transform."""
        return self._down(c, i) - self.first[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns (number, length): for each, the interval of suffixes that begin with it."""
        c = patterns[:, -1]
        low, high = self.smaller[c], self.smaller[c + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, k]
            low, high = self.smaller[c] + self.rank(c, low), self.smaller[c] + self.rank(c, high)
        return low, high
