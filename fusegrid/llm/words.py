"""Vectorised words: hashes of all words of an Arrow string column, without Python loops.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  These separators are single
bytes of UTF-8, so words are found on the raw bytes.  A word's hash folds its bytes,
eight at a time; equal words have equal hashes, and different ones collide with a
chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The bits of the first k bytes of a little-endian number.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, row) of every word, in order; ``gaps`` tells the bytes between words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.zeros(n + 8, np.uint8)
    text[:n] = _LOWER[data] if lower else data
    solid = ~gaps[text[:n]]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = solid[0], solid[n - 1]
    np.not_equal(solid[1:], solid[:-1], out=edge[1:n])
    bound = np.flatnonzero(edge)
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    cut = cut[solid[cut] & solid[cut - 1]]  # where a row ends within a run, one word ends and one begins
    if len(cut):
        bound = np.insert(bound, np.searchsorted(bound, np.repeat(cut, 2)), np.repeat(cut, 2))
    start, size = bound[::2], bound[1::2] - bound[::2]
    eight = np.ndarray(n + 1, "<u8", text.data, strides=(1,))
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        left = np.minimum(size[more] - at, 8)
        h[more] = mix(h[more] * np.uint64(0xD6E8FEB86659FD93) + (eight[start[more] + at] & _MASK[left]))
        at += 8
        more = more[size[more] > at]
    ends = np.searchsorted(start, offsets)
    return h, start, np.repeat(np.arange(len(offsets) - 1), np.diff(ends))


def shingles_of(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes: (hashes sorted within rows, row of each, set size of each row).

    A row with fewer words than ``width`` has its whole sequence as one shingle; a row without words has none.
    """
    count = np.bincount(row, minlength=n_rows)
    if not len(h):
        return h, row, count
    short = (count < width) & (count > 0)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    ok = np.arange(len(h)) + width <= (first + count)[row]
    at = np.flatnonzero(ok)
    s = np.zeros(len(at), np.uint64)
    for k in range(width):
        s = mix(s * np.uint64(0xD6E8FEB86659FD93) + h[at + k])
    rows = row[at]
    if short.any():
        where = np.flatnonzero(short)
        whole = np.zeros(len(where), np.uint64)
        for k in range(width - 1):
            more = count[where] > k
            whole[more] = mix(whole[more] * np.uint64(0xA0761D6478BD642F) + h[first[where[more]] + k])
        s, rows = np.concatenate((s, whole)), np.concatenate((rows, where))
    return distinct(s, rows, n_rows)


def distinct(s: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets from (value, row) pairs, sorted by row, then value."""
    order = np.argsort(s)
    order = order[np.argsort(rows[order], kind="stable")] if n_rows > 1 else order
    s, rows = s[order], rows[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (rows[1:] != rows[:-1])
    s, rows = s[new], rows[new]
    return s, rows, np.bincount(rows, minlength=n_rows)


def pack(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the next sizes[i] values."""
    ends = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
