"""Text columns as flat byte arrays: the shared ground of the byte-level operators.

A batch of texts is one ``uint8`` array plus offsets, cut into slices of a
bounded number of bytes, so memory does not follow the batch size or the length
of neighbouring documents (one document is never split).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hash and the seeds of its byte table (fixed so that hashes agree between tasks).
BASE = 0x9E3779B97F4A7C15 | 1
_table = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63 - 1, 256, dtype=np.int64).astype(U64) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (Stafford's variant 13)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)
_INV = pow(BASE, -1, 2**64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, BASE, U64)]))
            _inverses = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _INV, U64)]))


def release() -> None:
    """Give back what a task filled: the power tables of a long text, pooled and freed memory."""
    global _powers, _inverses
    if len(_powers) > 1 << 16:
        _powers, _inverses = _powers[: 1 << 16].copy(), _inverses[: 1 << 16].copy()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Callable, *forget: Callable[[], None]) -> Callable:
    """A batch function that leaves its reused worker as small as it found it; ``forget``: drop caches."""

    @wraps(run)
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            release()

    return whole


def prefix_hash(data: np.ndarray, table: np.ndarray = _table) -> np.ndarray:
    """h[i]: hash of data[:i]; see range_hash."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    t = table[data]
    t *= _powers[: len(data)]
    np.cumsum(t, out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of each data[start:end]."""
    return mix((h[end] - h[start]) * _inverses[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of the batches with at most ``most`` bytes of text each (or one row): (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = text_of(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def ids_of(rows: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    return rows.column(rows.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64)


def binaries(parts: list[np.ndarray]) -> pa.Array:
    """One binary value for each array."""
    return pa.array([p.tobytes() for p in parts], pa.binary())


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text as maximal runs of non-space bytes: (start, end, owner)."""
    solid = ~SPACE[data]
    before = np.empty_like(solid)
    if len(solid):
        before[0] = False
        before[1:] = solid[:-1]
    cut = off[1:-1][off[1:-1] < len(data)]
    before[cut] = False
    start = np.flatnonzero(solid & ~before)
    after = np.zeros_like(solid)
    after[:-1] = solid[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut <= len(data))] - 1
    after[cut] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1
