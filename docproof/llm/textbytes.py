"""Texts of an Arrow batch as one numpy byte array, with words found and hashed for all of
them at once. Words are runs of ``[^\\x20\\x09-\\x0D]``; everything works on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd 64-bit multipliers of the hashes below; any would do.
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SYMBOL = (np.arange(1, 257, dtype=np.uint64) * _M1) ^ (np.arange(1, 257, dtype=np.uint64) * _M2 >> np.uint64(23))
_POWERS = np.cumprod(np.full(1 << 12, _M2, dtype=np.uint64))


def text_blocks(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of ``batch`` with their bytes and offsets, about ``most_bytes`` at a time
    (a longer text comes alone); null texts are empty."""
    col = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row it is in."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole hash."""
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def positions(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all bytes of all words: where the byte is, its place in its word, where each word begins in these arrays."""
    sizes = ends - starts
    begin = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    return place + np.repeat(starts, sizes), place, begin


def hashed(symbols: np.ndarray, place: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, given its symbols (0 to 255) and their places."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    return mixed(np.add.reduceat(_SYMBOL[symbols] * _POWERS[place & 0xFFF] + place.astype(np.uint64), begin))


def pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each two neighbouring words of a row, and the row."""
    same = row[1:] == row[:-1]
    return mixed(h[:-1] * _M1 + (h[1:] ^ _M2))[same], row[1:][same]


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``size``-word shingle of a block, and where each text's shingles begin (and end)."""
    starts, ends, row = words(data, offsets)
    at, place, begin = positions(starts, ends)
    h = hashed(LOWER[data[at]], place, begin)
    count = np.bincount(row, minlength=len(offsets) - 1)
    whole = np.maximum(count - size + 1, 0)
    first = np.repeat(np.cumsum(count) - count, whole)
    cut = np.append(0, np.cumsum(whole))
    i = first + np.arange(int(whole.sum())) - np.repeat(cut[:-1], whole)
    out = np.zeros(len(i), np.uint64)
    for k in range(size):
        out = mixed(out ^ h[i + k]) if len(i) else out
    return out, cut
