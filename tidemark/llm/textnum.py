"""Whole-batch text arithmetic on Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D. All functions work on
the concatenated UTF-8 bytes of a batch, with no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit words (xor-shift multiply, twice)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

def trim() -> None:
    """Give memory that a finished task has freed back to the system; the worker lives on."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Calls that empty what an operator keeps in a worker from task to task.
held: list = []


def give_way() -> None:
    """Empty other operators' caches when a task of another kind runs in the same worker."""
    if held:
        for f in held:
            f()
        held.clear()
        trim()


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i <= n."""
    if len(_powers[0]) <= n:
        size = max(1 << 20, 1 << (n + 1).bit_length())
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(col: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    _, off = column_bytes(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[raw]
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    cut = off[(off > 0) & (off < len(raw))]
    before[cut] = False
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    after[cut - 1] = False
    start = np.flatnonzero(ink & ~before)
    end = np.flatnonzero(ink & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_hash` gets any span's hash."""
    give_way()
    p, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * p[: len(raw)], out=out[1:])
    return out


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span, independent of where it stands."""
    _, inv = powers(len(run))
    return mix64((run[end] - run[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed))


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words.

    Rows with fewer words, but any, have one shingle of all their words.
    """
    n = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]) if n_rows else np.zeros(0, np.int64)
    k = np.maximum(n - width + 1, np.minimum(n, 1))
    at = np.repeat(first - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum()) if n_rows else np.zeros(0, np.int64)
    at = at.astype(np.int64)
    who = np.repeat(np.arange(n_rows), k)
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        has = j < n[who]
        out = mix64(out + np.where(has, h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else np.uint64(0), np.uint64(j + 1)))
    return out, who
