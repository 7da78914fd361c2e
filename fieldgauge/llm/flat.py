"""Texts of an Arrow batch as one byte buffer, and hashes of its slices.

The operators work on slices of a batch of bounded size, so memory follows the longest text and
not the number of rows. Slice hashes are polynomials modulo 2**64 over a random byte table: two
slices of one length or of different lengths that differ share a value with probability about
2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def texts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = array.cast(pa.large_binary() if pa.types.is_binary(array.type) else pa.large_string())
    if wide.null_count:
        wide = pc.fill_null(wide, b"" if pa.types.is_large_binary(wide.type) else "")
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64, len(wide) + 1, wide.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts stay below ``limit`` bytes, or single rows beyond it."""
    _, at = texts(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base or of its inverse."""
    held = _POWERS[inverse]
    if len(held) < n:
        step = np.full(max(n, 1 << 16), _BASE_INVERSE if inverse else _BASE, np.uint64)
        step[0] = 1
        held = _POWERS[inverse] = np.multiply.accumulate(step)
    return held[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, one more than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices, independent of where they lie."""
    return mix((prefix[end] - prefix[begin]) * powers(len(prefix), True)[begin])


def sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` between neighbouring offsets."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[at])


GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each maximal run without ASCII white space, and the first word of each row (n + 1)."""
    inside = ~GAPS[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = at[:-1][at[:-1] < at[1:]]
    begin[first] = inside[first]
    end[first[1:] - 1] = inside[first[1:] - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs again, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, later
