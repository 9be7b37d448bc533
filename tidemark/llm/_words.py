"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D). UTF-8 keeps those bytes for
themselves, so working on bytes and on characters gives the same words. Each word gets a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all non-ASCII bytes: words without ASCII punctuation.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; those of an ordinary slice are kept."""
    key = str(base)
    if key in _powers and n <= len(_powers[key]):
        return _powers[key][:n]
    out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out = np.multiply.accumulate(out)
    if n <= SLICE_BYTES + 1:
        _powers[key] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in the bytes) over slices of about ``size`` bytes; null is ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and each row's offset among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words; with ``lower``, A-Z count as a-z."""
    return run_hashes(data, starts, [ends], lower)[0]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: list[np.ndarray], lower: bool = False) -> list[np.ndarray]:
    """Hashes of the bytes from ``starts`` to each of ``ends``, of which the first goes furthest; long texts go in parts of some SLICE_BYTES."""
    out, k = [np.empty(len(starts), np.uint64) for _ in ends], 0
    while k < len(starts):
        first = int(starts[k])
        last = max(k + 1, int(np.searchsorted(ends[0], first + SLICE_BYTES, "right")))
        part = data[first : int(ends[0][last - 1])]
        at = starts[k:last] - first
        with np.errstate(over="ignore"):
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[part] * _power(_BASE, len(part)), out=sums[1:])
            begun, scale = sums[at], _power(_BASE_INV, len(part))[at]
            for own, e in zip(out, ends):
                to = e[k:last] - first
                own[k:last] = mix((sums[to] - begun) * scale + (to - at).astype(np.uint64))
        k = last
    return out
