"""Vectorised scans of text columns as UTF-8 bytes.

A slice is a run of rows whose texts lie one behind another in one byte array;
slices hold a few MB (or one longer text), so that working arrays stay small
whatever the Arrow batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_libc = ctypes.CDLL(None)

SLICE_BYTES = 1 << 20
#: Scans of a slice work on so many bytes at a time, however long its texts are.
CHUNK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: One odd-ish random 64-bit value for each byte value.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INV: np.ones(1, np.uint64)}

#: ASCII letters to lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that are runs of anything but white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words that are runs of ASCII letters, ASCII digits and all non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; kept and grown by doubling."""
    have = _powers[base]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 2**64))
        have = np.concatenate([have, have * step])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    base = np.frombuffer(data, np.uint8)
    return base[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``size`` bytes."""
    data, offsets = column_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release(len(data))


#: Bytes of text after which freed memory is given back.
RELEASE_BYTES = 32 << 20
_since = 0


def release(size: int = RELEASE_BYTES) -> None:
    """Every ``RELEASE_BYTES`` of text: gives back to the system what freed arrays and batches have left with the allocators of a long-lived worker."""
    global _since
    _since += size
    if _since < RELEASE_BYTES:
        return
    _since = 0
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim:
        trim(0)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``member`` bytes, cut at row ends; first word of each row."""
    starts, ends, inner = [], [], False  # inner: the byte before the chunk is in a run
    for a in range(0, len(data), CHUNK):
        inside = member[data[a : a + CHUNK]]
        before = np.empty(len(inside), bool)
        before[0] = inner
        before[1:] = inside[:-1]
        begins = inside & ~before
        stops = before & ~inside
        edges = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + len(inside))] - a
        begins[edges] = inside[edges]
        stops[edges] = before[edges]
        starts.append(np.flatnonzero(begins) + a)
        ends.append(np.flatnonzero(stops) + a)
        inner = bool(inside[-1])
    none = np.zeros(0, np.int64)
    ends.append(np.array([len(data)], np.int64) if inner else none)
    starts = np.concatenate([none, *starts])
    return starts, np.concatenate(ends), np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end), which ascend and don't overlap; equal for equal bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        last = int(ends[j - 1])
        if last - base > CHUNK:  # one run of more than a chunk
            out[i] = _long_sum(data[base:last])
        else:
            total = np.zeros(last - base + 1, np.uint64)
            np.cumsum(BYTE_VALUE[data[base:last]] * power(_BASE, last - base), out=total[1:])
            a, b = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (total[b] - total[a]) * power(_BASE_INV, last - base + 1)[a]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def _long_sum(data: np.ndarray) -> int:
    total = 0
    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK]
        total += int(np.sum(BYTE_VALUE[part] * power(_BASE, len(part)))) * pow(_BASE, a, 2**64)
    return total % 2**64


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, at each first word (rows are not looked at)."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    out = word[: len(word) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + word[k : len(word) - n + 1 + k])
    return out


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_grams(first: np.ndarray, n: int) -> np.ndarray:
    """Positions of items at which n items of the same row begin."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    row = row_of(first)
    return np.flatnonzero(row[: total - n + 1] == row[n - 1 :])
