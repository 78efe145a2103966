"""Distinct word shingles of many texts at once, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from codeweft.llm.arrays import U64, mixed, span_hashes


class Shingler:
    """Shingles of ``words`` words; A-Z are lower-cased, words are split at ASCII white space."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.white = np.zeros(256, dtype=bool)
        self.white[[32, 9, 10, 11, 12, 13]] = True
        self.factors = [U64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(words)]

    def of(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each text its set; a text with fewer words has its whole sequence as one shingle."""
        n = len(offsets) - 1
        empty = np.zeros(0, U64)
        if not len(data):
            return [empty] * n
        dark = ~self.white[data]
        start = dark.copy()
        start[1:] &= ~dark[:-1]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[begins] = dark[begins]
        stop = dark.copy()
        stop[:-1] &= ~dark[1:]
        stop[begins[1:] - 1] = dark[begins[1:] - 1]
        at, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        word = span_hashes(self.lower[data], at, ends)
        bounds = np.searchsorted(at, offsets)  # words of text i: bounds[i] to bounds[i + 1]
        k = self.words
        size = max(0, len(word) - k + 1)
        rolled = np.zeros(size, U64)
        for j in range(k):
            rolled += word[j : j + size] * self.factors[j]
        rolled = mixed(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                short = U64(b - a)
                with np.errstate(over="ignore"):
                    for j in range(b - a):
                        short = short + word[a + j] * self.factors[j]
                out.append(mixed(np.array([short ^ U64(0x5851F42D4C957F2D)], dtype=U64)))
            else:
                out.append(empty)
        return out
