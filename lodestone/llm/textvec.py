"""Vectorised word access over Arrow string columns: words, word hashes and byte classes without Python objects per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = mix64(np.arange(1, 256 * 64 + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_ODD = _U(0xD6E8FEB86659FD93)


def chunks(col: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES, max_rows: int = 1000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets of the rows in bytes); a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        hi = min(hi, lo + max_rows)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[buf]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each word) of the words [^\\x20\\x09-\\x0D]+; none crosses a row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (tabulation by byte and place, then a finaliser with the length)."""
    if not len(starts):
        return np.zeros(0, _U)
    lens = ends - starts
    total = int(lens.sum())
    firsts = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=firsts[1:])
    pos = np.arange(total) - np.repeat(firsts, lens)
    at = pos + np.repeat(starts, lens)
    vals = _TABLE[(buf[at].astype(np.int64) << 6) | (pos & 63)]
    if lens.max() > 64:
        far = np.flatnonzero(pos >= 64)
        scale = _ODD * (2 * (pos[far] >> 6).astype(_U) + _U(1))
        vals[far] = mix64(vals[far] ^ scale)
    return mix64(np.add.reduceat(vals, firsts) + lens.astype(_U) * _ODD)


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)
