"""Whole texts as flat byte arrays: vectorised words and rolling fingerprints.

A chunk is a run of consecutive rows whose UTF-8 bytes lie end to end. Words and
fingerprints never cross the border between two rows. A row longer than the chunk
limit is a chunk of its own; nothing is cut.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20

WORD_SEPARATOR = np.zeros(256, bool)
WORD_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

ALNUM_SEPARATOR = np.zeros(256, bool)
ALNUM_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Masks of the first n of 8 bytes.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Symbols of a window that a rolling fingerprint may stand for.
WIDEST = 400


class Rolling:
    """Polynomial fingerprints modulo 2**64 of any slice of a sequence of values.

    For short windows over mixed values: patterns that defeat this modulus for every base
    (the Thue-Morse sequence) need about a thousand symbols; windows have ``WIDEST`` at most.
    """

    def __init__(self, seed: int):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.base = int(draw.integers(1 << 62, 1 << 63)) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.byte_value = draw.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
        self._up = self._down = np.ones(1, U)

    def _powers(self, base: int, n: int) -> np.ndarray:
        out, filled = np.ones(n, U), 1
        while filled < n:
            more = min(filled, n - filled)
            out[filled : filled + more] = out[:more] * U(pow(base, filled, 1 << 64))
            filled += more
        return out

    def _reach(self, n: int) -> None:
        if len(self._up) < n:
            n = max(n, CHUNK_BYTES + 1)
            self._up, self._down = self._powers(self.base, n), self._powers(self.inverse, n)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._reach(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * self._up[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self._down[start]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Fingerprint of every slice of ``width`` values, by start."""
        n = len(prefix) - width
        return (prefix[width:] - prefix[:n]) * self._down[:n] if n > 0 else np.zeros(0, U)


_rolling: dict[int, Rolling] = {}


def rolling(seed: int) -> Rolling:
    """One table of powers per worker process and seed."""
    if seed not in _rolling:
        _rolling[seed] = Rolling(seed)
    return _rolling[seed]


class Chunk:
    """Rows ``lo:hi`` of a batch. ``offset`` has their byte borders in ``data``."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offset: np.ndarray):
        self.lo, self.hi, self.data, self.offset = lo, hi, data, offset
        self.rows = hi - lo

    def words(self, separator: np.ndarray, data: np.ndarray | None = None):
        """Starts and ends (bytes) of all words, and the row of each."""
        data = self.data if data is None else data
        inside = ~separator[data]
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, none
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        border = self.offset[:-1][(self.offset[:-1] < len(data)) & (np.diff(self.offset) > 0)]
        first[border] = inside[border]
        border = border[border > 0] - 1
        last[border] = inside[border]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(self.offset, start, "right") - 1

    def fingerprints(self, start, end, seed: int, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit names of the words: sums of mixed blocks of 8 bytes, each keyed by its place.

        One-to-one on words of one length up to 8 bytes; beyond that the mixing leaves no
        pattern by which two words agree.
        """
        length = end - start
        if not len(length):
            return np.zeros(0, U)
        data = self.data if data is None else data
        blocks = (length + 7) >> 3
        first = np.cumsum(blocks) - blocks
        nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        at = np.repeat(start, blocks) + 8 * nth
        lane = np.ndarray((len(data),), "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,))
        value = lane[at] & LOW_BYTES[np.minimum(np.repeat(end, blocks) - at, 8)]
        key = mix(np.arange(int(blocks.max()), dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        value = mix(value ^ key[nth])
        if len(value) > len(length):
            value = np.add.reduceat(value, first)
        return mix(value + length.astype(U) * U(0xC2B2AE3D27D4EB4F))


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte borders and bytes of a string or binary column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offset = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return offset, data


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if not len(column):
        return
    offset, data = binary_buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offset, offset[lo] + limit, "right")) - 1))
        yield Chunk(lo, hi, data[offset[lo] : offset[hi]], offset[lo : hi + 1] - offset[lo])
        lo = hi


def portions(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one longer row.

    Idle workers are kept for later tasks, so at the end memory goes back to the system.
    """
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            so_far = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, so_far + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch
    gc.collect()
    give_back()


def give_back() -> None:
    """Freed memory goes from the worker back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def then_give_back(run):
    """``run`` on a table, after which the worker gives its freed memory back: it idles between tasks."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return wrapped


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices of ``data``, end to end."""
    ends = np.cumsum(length)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)]


def equal_slices(a: np.ndarray, place_a: np.ndarray, b: np.ndarray, place_b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Does each slice of ``a`` equal that of ``b``, byte for byte?"""
    differs = gather(a, place_a, length) != gather(b, place_b, length)
    return np.bincount(np.repeat(np.arange(len(length)), length), weights=differs, minlength=len(length)) == 0


def slice_binary(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """A binary column: entry i is ``values[borders[i]:borders[i + 1]]``."""
    values = np.ascontiguousarray(values)
    offset = np.asarray(borders, np.int64) * values.itemsize
    if len(offset) and offset[-1] > np.iinfo(np.int32).max:
        raise ValueError("a column of more than 2 GB in one batch: use smaller parts, or split such a text")
    offset = offset.astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offset) - 1, [None, pa.py_buffer(offset), pa.py_buffer(values)])


def ragged(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column end to end, and each entry's count of values."""
    offset, data = binary_buffers(column)
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(data[offset[0] : offset[-1]].tobytes(), dtype) if len(column) else np.zeros(0, dtype)
    return flat, np.diff(offset) // size


def spans_of(mask: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within one row."""
    if not mask.any():
        none = np.zeros(0, np.int64)
        return none, none
    edge = np.r_[True, row[1:] != row[:-1]]
    begins = mask & (edge | ~np.r_[False, mask[:-1]])
    ends = mask & np.r_[edge[1:] | ~mask[1:], True]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_lists(start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """One list of {start, end} structs for each row; ``row`` ascends."""
    border = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    pair = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(border), pair)
