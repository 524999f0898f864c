"""Vectorised text primitives for Arrow batches.

Texts stay in the one UTF-8 buffer that Arrow hands over; words, lines and
windows are index arrays into it. Hashes are 64 bits wide: polynomials over
bytes, finished with a strong bit mixer.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _BASE), ("_inverses", _BASE_INV)):
                table = np.full(size, base, U64)
                table[0] = 1
                globals()[name] = np.multiply.accumulate(table)
    return _powers, _inverses


def lean(fn: Callable) -> Callable:
    """A batch function that gives unused memory back when its task ends: workers
    live on, and what one task needed would else add to the next one's."""
    @wraps(fn)
    def run(batches: Iterator[pa.RecordBatch], *more) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches, *more)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library keeps its own counsel
    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def pieces(off: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span, whatever its place."""
    powers, inverses = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers[:len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverses[start]
    return mix64(h + (end - start).astype(U64) * _BASE)


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (n + 1 values)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    start = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    end = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a per-byte (or per-word) array over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes; runs across texts are the caller's to drop."""
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, U64)
    for k in range(width):
        h = h * _BASE + words[k:k + n]
    return mix64(h)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text: sorted distinct hashes of its lower-cased word shingles.

    A text of fewer words than ``width`` has its whole sequence as the only
    shingle; a text without words has none.
    """
    low = LOWER[data]
    start, end, first = word_bounds(low, off)
    words = span_hashes(low, start, end)
    full = window_hashes(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a:b - width + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b] + U64(b - a), b - a))
        else:
            out.append(words[:0])
    return out
