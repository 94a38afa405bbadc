"""Vectorised text kernels over the buffers of an Arrow string column.

A batch of texts is one byte array with offsets. Words, lines and their 64-bit keys are found with numpy over the
whole array, in slices of SLICE bytes, so that memory is bounded by the slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE_KEY = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
STEP = U(0x5851F42D4C957F2D)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def slices(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of texts of about SLICE bytes; null is the empty text."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    array = array.cast(pa.large_binary()).fill_null(b"")
    n = len(array)
    if not n:
        return
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, side="right")) - 1)
        yield at, min(end, n), raw[off[at] : off[min(end, n)]], off[at : min(end, n) + 1] - off[at]
        at = min(end, n)


def spans(data: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes that are no separators, inside each text."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = off[:-1][off[:-1] < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of the byte runs; equal runs have equal keys in every batch."""
    if not len(starts):
        return np.zeros(0, U)
    length = ends - starts
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), STEP, U))
    inside = np.repeat(starts, length) + place
    return mix(np.add.reduceat(BYTE_KEY[data[inside]] * power[place], first) + length.astype(U))


def windows(word: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word numbers and keys of all windows of size words that lie in one text."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    key = np.zeros(n, U)
    for k in range(size):
        key = key * STEP + word[k : k + n]
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return at, mix(key[at])


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a value for each byte, for each text."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def repeated(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its text has its key more than once, and whether an earlier entry has it."""
    order = np.lexsort((np.arange(len(key)), key, text))
    t, k = text[order], key[order]
    same = np.zeros(len(key), bool)
    same[1:] = (t[1:] == t[:-1]) & (k[1:] == k[:-1])
    again = same.copy()
    again[:-1] |= same[1:]
    out, earlier = np.empty(len(key), bool), np.empty(len(key), bool)
    out[order], earlier[order] = again, same
    return out, earlier
