"""Array helpers for operators that see whole texts in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 20

U64 = np.uint64


#: A column of a batch by its name, or what finds it in the batch.
Place = str | Callable[[pa.RecordBatch], pa.Array]


def slices(batch: pa.RecordBatch, column: Place, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``most`` bytes of ``column``."""
    if batch.num_rows == 0:
        return
    texts = column(batch) if callable(column) else batch.column(column)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def over_slices(column: Place, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], most: int = SLICE_BYTES) -> Callable:
    """A function for mapInArrow that applies ``make()``'s result to each slice of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, column, most):
                yield work(part)

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


#: Spans beyond this many bytes are hashed one by one, by BLAKE2b.
LONG_SPAN = 512


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings start..end, equal for equal strings wherever they stand.

    Eight bytes at a time are taken into the state by exclusive or, and every step mixes the whole
    state; a hash is no sum over places, so words built from repeating patterns don't meet.
    """
    size = (end - start).astype(np.int64)
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 8,), dtype="<u8", buffer=padded.data, strides=(1,))
    out = mixed(size.astype(U64) + U64(0x2545F4914F6CDD1D))
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while len(live):
        left = size[live] - done
        part = eight[start[live] + done]
        short = left < 8
        part[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
        out[live] = mixed(out[live] ^ part)
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)
        rng = np.random.default_rng(20240229)
        #: A random 64-bit value for each byte, so that equal sums of bytes don't meet.
        self.of_byte = rng.integers(1, 1 << 63, 256, dtype=U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            inverse = pow(self.BASE, -1, 1 << 64)
            for name, base in (("up", self.BASE), ("down", inverse)):
                row = np.full(n, base, dtype=U64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums H with H[j] - H[i] = hash of bytes i..j times base**i."""
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], out=out[1:])
        return out

    def of_spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte strings start..end, equal for equal strings wherever they stand."""
        return mixed((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
