"""Words of whole texts, cut from their UTF-8 bytes, for many texts at once.

Where every separator is an ASCII sign, words can be cut at bytes: no byte of a longer code point is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(values) -> np.ndarray:
    """A truth table over bytes."""
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


class ByteWords:
    """Maximal runs of ``inside`` bytes of each text; A-Z are lower-cased.

    ``start`` and ``end`` are places in ``data``, ``row`` is the text a word stands in, ``code`` its number in
    ``words``, the distinct words of all texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> None:
        self.data = LOWER[data]
        dark = inside[data]
        start, stop = dark.copy(), dark.copy()
        start[1:] &= ~dark[:-1]
        stop[:-1] &= ~dark[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[begins] = dark[begins]
        stop[begins[1:] - 1] = dark[begins[1:] - 1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(self.start, offsets)))
        ends = np.zeros(len(self.start) + 1, dtype=np.int64)
        np.cumsum(self.end - self.start, out=ends[1:])
        kept = pa.py_buffer(self.data[dark].tobytes())
        coded = pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(ends.tobytes()), kept).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary
