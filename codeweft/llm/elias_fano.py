"""Elias-Fano code of a monotone sequence, with select samples.

Of n values up to u, the lowest floor(log2(u / n)) bits of each are packed, and the rest are stored in unary in a bit vector
of at most 3 n bits: the i-th set bit stands at place (value >> low) + i. The place of every ``SAMPLE``-th set bit is kept
in 32 bits, so one value is found by reading a short stretch of the vector, and no table has 64 bits for each value.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
#: Values packed at a time; a multiple of eight, so each part ends at a byte.
PART = 1 << 16
HEAD = struct.Struct("<QQQI")
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


class EliasFano:
    def __init__(self, n: int, low: int, lows: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low, self.lows, self.high, self.samples = n, low, lows, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """The code of values that never fall; at most 2**63."""
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        bits = np.arange(low, dtype=np.uint64)
        parts = [np.packbits((values[i : i + PART, None] >> bits & np.uint64(1)).astype(np.uint8), bitorder="little") for i in range(0, n, PART)] if low else []
        place = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(place[-1]) + 1 if n else 0, dtype=bool)
        unary[place] = True
        lows = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return cls(n, low, lows, np.packbits(unary, bitorder="little"), place[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = HEAD.pack(self.n, len(self.lows), len(self.high), self.low)
        return b"".join([head, self.lows.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, lows, high, low = HEAD.unpack_from(data)
        if len(data) != HEAD.size + lows + high + 4 * (-(-n // SAMPLE)):
            raise ValueError("not an Elias-Fano code")
        at = HEAD.size
        rest = np.frombuffer(data, np.uint8, offset=at) if len(data) > at else np.zeros(0, np.uint8)
        return cls(n, low, rest[:lows], rest[lows : lows + high], rest[lows + high :].view("<u4"))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One value: from the sample before it, bytes are passed over by their counts of set bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # set bits to pass over, from the sampled one on
        at = place // 8
        ones = np.flatnonzero(np.unpackbits(self.high[at : at + 1], bitorder="little")[place % 8 :]) + place
        while len(ones) <= left:
            left -= len(ones)
            at += 1
            stretch = np.cumsum(BITS_OF_BYTE[self.high[at : at + 64]])
            skip = int(np.searchsorted(stretch, left, side="right"))
            if skip:
                left -= int(stretch[skip - 1])
                at += skip
            ones = np.flatnonzero(np.unpackbits(self.high[at : at + 1], bitorder="little")) + 8 * at
        upper = int(ones[left]) - i
        first = i * self.low
        chunk = int.from_bytes(self.lows[first // 8 : (first + self.low + 7) // 8].tobytes(), "little")
        return upper << self.low | (chunk >> first % 8 & (1 << self.low) - 1)

    def values(self) -> np.ndarray:
        """All values."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        out = (place - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        for i in range(0, self.n if self.low else 0, PART):
            size = min(PART, self.n - i)
            packed = self.lows[i * self.low // 8 : ((i + size) * self.low + 7) // 8]
            bits = np.unpackbits(packed, bitorder="little", count=size * self.low).reshape(size, self.low)
            out[i : i + size] |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def first_at_least(self, value: int) -> int:
        """The first index whose value is not below ``value``, or the length."""
        a, b = 0, self.n
        while a < b:
            middle = (a + b) // 2
            if self[middle] < value:
                a = middle + 1
            else:
                b = middle
        return a
