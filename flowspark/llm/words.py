"""Words and word shingles of whole texts as 64-bit hashes, a batch at a time.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR, with A-Z
lower-cased. The functions work on the UTF-8 buffers of an Arrow string column, so
that no Python object is made for a word: a polynomial prefix sum over the bytes
(arithmetic modulo 2**64) gives the hash of any word as one subtraction.

Null texts are empty texts: no words, no shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1 << 20
_RNG = np.random.default_rng(20240607)
_VALUE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True) | np.uint64(1)
_VALUE_BYTES = _VALUE.copy()
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)
_GAP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_R, 1 << 16)
_DOWN = _powers(_R_INV, 1 << 16)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of them at least."""
    global _UP, _DOWN
    if n >= len(_UP):
        _UP, _DOWN = _powers(_R, n + 1), _powers(_R_INV, n + 1)
    return _UP[:n], _DOWN[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text each, or of one row where it is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield start, len(size)


def sliced(batches: Iterator[pa.RecordBatch], text: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, at most `limit` bytes of the text column at a time."""
    for batch in batches:
        for a, b in slices(batch.column(text), limit):
            yield batch.slice(a, b - a)


def span_hashes(buf: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from start and end places to the hashes of the bytes between, A-Z as a-z."""
    up, down = powers(len(buf))
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.multiply(_VALUE[buf], up, out=acc[1:])
    np.cumsum(acc[1:], out=acc[1:])
    return lambda start, stop: mix((acc[stop] - acc[start]) * down[start] + (stop - start).astype(np.uint64))


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte of each word; for each text the index of its first word, and the total)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < n]
    begins[first] |= inside[first]
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = span_hashes(buf)(start, stop)
    return h, start, stop, np.searchsorted(start, off)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h += words[j : j + n] * _GAP[j]
    return mix(h)


def shingle_sets(column: pa.Array, size: int = 5, limit: int = BATCH_BYTES) -> Iterator[np.ndarray]:
    """For each text in turn its distinct shingle hashes, ascending."""
    for a, b in slices(column, limit):
        buf, off = text_buffers(column.slice(a, b - a))
        h, _, _, at = word_hashes(buf, off)
        for i in range(b - a):
            s = np.sort(shingle_hashes(h[at[i] : at[i + 1]], size))
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
