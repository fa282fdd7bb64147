"""Vectorised reading of Arrow string columns as bytes: words and their 64-bit hashes, without Python strings.

Lower-casing covers ASCII and the Latin-1 letters of UTF-8; every byte from 0x80 on counts as a letter.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_WORD[95] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def tidy() -> None:
    """Gives freed memory back to the system; workers live on after a task, and their memory counts for the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about ``limit`` bytes (one row at least).

    Yields the first row's number, the bytes, and the n+1 offsets of the rows in them. Every text is
    set between spaces, so that no word or n-gram spans two rows. Nulls read as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = pc.fill_null(column, "").cast(pa.large_string())
    gap = pa.scalar(" ", pa.large_string())
    column = pc.binary_join_element_wise(gap, column, gap, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def lower(buf: np.ndarray) -> np.ndarray:
    low = _LOWER[buf]
    lead = np.flatnonzero(low[:-1] == 0xC3) + 1
    if len(lead):
        second = low[lead]
        up = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
        low[up] += 32
    return low


def points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a slice of UTF-8 as numbers, and the rows' offsets in them."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    if len(at) == len(buf):
        return buf.astype(np.uint32), offsets
    out = buf[at].astype(np.uint32)
    long = np.flatnonzero(out >= 0xC0)
    lead = out[long]
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    value = lead & (np.uint32(0x7F) >> size.astype(np.uint32))
    for k in range(1, 4):
        own = size > k
        value[own] = value[own] << np.uint32(6) | buf[at[long[own]] + k] & np.uint32(0x3F)
    out[long] = value
    return out, np.searchsorted(at, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, for n positions."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + (1 << 17))
        for name, base in (("p", _P), ("q", _P_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, from prefix sums of a polynomial modulo 2**64."""
    p, q = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts])


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the words of a lower-cased slice, in order."""
    inside = _WORD[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # a text begins and ends with a space
    starts, ends = edges[0::2], edges[1::2]
    return np.searchsorted(offsets, starts, side="right") - 1, span_hashes(buf, starts, ends)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`words`, but runs of punctuation are tokens of their own."""
    kind = np.where(_WORD[buf], 1, np.where(_SPACE[buf], 0, 2)).astype(np.int8)
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return np.searchsorted(offsets, starts, side="right") - 1, span_hashes(buf, starts, ends)


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)
