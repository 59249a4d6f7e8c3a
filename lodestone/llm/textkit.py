"""Vectorised text kernel: UTF-8 bytes of Arrow batches to word boundaries and 64-bit word hashes.

Works on slices of about a megabyte, whatever the Arrow batch holds, so that memory stays bounded;
only a single text longer than that makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Byte classes: space of the word pattern, letters and digits (any byte beyond ASCII counts as a letter).
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(salt)) * np.uint64(0xA0761D6478BD642F) + np.uint64(salt + 1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if pa.types.is_binary(column.type) else column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, at least one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``member`` bytes; runs never cross rows."""
    n = len(member)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = member.copy()
    start[1:] &= ~member[:-1] | edge[1:n]
    end = member.copy()
    end[:-1] &= ~member[1:] | edge[1:n]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def run_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    lens = e - s
    at = np.cumsum(lens) - lens
    inside = np.arange(at[-1] + lens[-1]) - np.repeat(at, lens)
    power = np.empty(int(lens.max()), np.uint64)
    power[0] = np.uint64(1)
    if len(power) > 1:
        power[1:] = _STEP
        power = np.multiply.accumulate(power)
    chars = buf[inside + np.repeat(s, lens)]
    return mix(np.add.reduceat(_BYTE[chars] * power[inside], at) + lens.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))


def words(buf: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the white-space separated words; A-Z lower-cased if ``lower``."""
    s, e, row = runs(~SPACE[buf], off)
    return run_hashes(LOWER[buf] if lower else buf, s, e), row


def one_batch(names: list[str], types: list[pa.DataType], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) if not isinstance(a, pa.Array) else a for a, t in zip(arrays, types, strict=True)], names=names)
