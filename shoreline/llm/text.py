"""Words of Arrow text columns as arrays of 64-bit hashes.

All documents of a slice are handled together on their UTF-8 bytes, so the cost per byte is a
few array operations. A word's hash is a polynomial over random byte values, taken from one
running sum, and mixed at the end; equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~0x7 | 0x3)
_BYTES = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up: np.ndarray
    down: np.ndarray

    def upto(self, n: int) -> Powers:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            ones = np.ones(n, dtype=np.uint64)
            for name, step in (("up", _BASE), ("down", inverse)):
                steps = ones * step
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self


_POWERS = Powers(np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into the bytes); null counts as empty.

    A slice holds whole documents: at least one, and no more than ``limit`` bytes beyond that.
    """
    column = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words of a slice: hash, document number in the slice, and first word of each document."""

    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # one more than there are documents
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray

    def prefix(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of every word (of all of a shorter one)."""
        return _hash(self.sums, self.starts, np.minimum(self.starts + n, self.ends))


def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _POWERS.down[starts])


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Split at white space (bytes 9-13 and 32); documents never share a word."""
    n = len(data)
    powers = _POWERS.upto(n + 1)
    inside = ~space[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers.up[:n], out=sums[1:])
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(_hash(sums, starts, ends), doc, first, starts, ends, sums)
