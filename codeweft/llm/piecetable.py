"""A bounded table from pieces to their token ids, filled as new pieces are met."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from codeweft.llm.arrays import U64, mixed

#: Token ids kept between batches; beyond it the table starts anew, which costs time only.
MOST_IDS = 3_000_000


class PieceTable:
    """Ids of pieces. A 64-bit hash finds the place; the code points kept there decide.

    A piece whose hash is taken by another piece is encoded on its own, so collisions cost time only.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]) -> None:
        self.encode = encode
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U64)
        self.entry = np.zeros(0, np.int64)  # by key: number of the piece
        self.where = np.zeros(0, np.int64)  # by piece: place of the first id
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.text_at = np.zeros(0, np.int64)  # by piece: place of its code points
        self.text_size = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint16)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                row = np.full(n, base, dtype=U64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))

    def _add(self, text: str, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encode pieces and keep them; their numbers."""
        got = self.encode([text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        sizes = np.fromiter((len(x) for x in got), np.int32, len(got))
        first, lengths = len(self.where), end - start
        self.where = np.concatenate([self.where, len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))])
        self.text_at = np.concatenate([self.text_at, len(self.text) + np.cumsum(lengths) - lengths])
        self.text_size = np.concatenate([self.text_size, lengths])
        self.text = np.concatenate([self.text, codes[spread(start, lengths)].astype(np.uint16)])
        return np.arange(first, len(self.where))

    def _differ(self, entry: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the pieces that are not what their entries hold."""
        lengths = end - start
        other = self.text_size[entry] != lengths
        same = np.flatnonzero(~other)
        mine, kept = codes[spread(start[same], lengths[same])], self.text[spread(self.text_at[entry[same]], lengths[same])]
        off = np.flatnonzero(mine != kept)
        if len(off):
            other[same[np.searchsorted(np.cumsum(lengths[same]), off, side="right")]] = True
        return np.flatnonzero(other)

    def lookup(self, text: str, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, size) in ``self.ids`` of each piece; ``text`` is what ``codes``, all below 2**16, are the code points of."""
        self._grow(len(codes) + 1)
        prefix = np.zeros(len(codes) + 1, dtype=U64)
        np.cumsum(mixed(codes.astype(U64) + U64(0x51ED270B)) * self.up[: len(codes)], out=prefix[1:])
        key = mixed((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64))
        if len(self.ids) > MOST_IDS:
            self.clear()
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        missing = self.keys[at] != key if len(self.keys) else np.ones(len(key), dtype=bool)
        if missing.any():
            fresh, first = np.unique(key[missing], return_index=True)
            place = np.flatnonzero(missing)[first]
            entry = self._add(text, codes, start[place], end[place])
            keys = np.concatenate([self.keys, fresh])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.entry = np.concatenate([self.entry, entry])[order]
            at = np.searchsorted(self.keys, key)
        entry = self.entry[at]
        wrong = self._differ(entry, codes, start, end)
        if len(wrong):
            entry[wrong] = self._add(text, codes, start[wrong], end[wrong])
        return self.where[entry], self.size[entry]

    def gather(self, where: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids end to end, and the running count of ids before each piece."""
        before = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=before[1:])
        return self.ids[spread(where, size)], before


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
