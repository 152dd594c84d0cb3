"""XXH64 of many byte strings at once, as the published algorithm defines it."""

from __future__ import annotations

import numpy as np

# The primes of XXH64.
_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)
_P4 = np.uint64(0x85EBCA77C2B2AE63)
_P5 = np.uint64(0x27D4EB2F165667C5)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hash of ``data[starts[i]:ends[i]]`` for each i."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place
    four = np.ndarray((len(data) + 5,), "<u4", padded.data, strides=(1,))
    size = ends - starts
    h = np.full(len(starts), seed, np.uint64) + _P5
    at = starts.copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        base = np.full(len(long), seed, np.uint64)
        acc = [base + _P1 + _P2, base + _P2, base, base - _P1]
        stripes, live = size[long] // 32, np.arange(len(long))
        acc[2] = base.copy()
        for k in range(int(stripes.max())):
            live = live[stripes[live] > k]
            p = starts[long[live]] + 32 * k
            for i in range(4):
                acc[i][live] = _round(acc[i][live], eight[p + 8 * i])
        one = _turned(acc[0], 1) + _turned(acc[1], 7) + _turned(acc[2], 12) + _turned(acc[3], 18)
        for v in acc:
            one = (one ^ _round(np.zeros(1, np.uint64), v)) * _P1 + _P4
        h[long] = one
        at[long] += 32 * stripes
    h += size.astype(np.uint64)
    rest = ends - at
    for k in range(3):
        i = np.flatnonzero(rest >= 8 * (k + 1))
        h[i] = _turned(h[i] ^ _round(np.zeros(1, np.uint64), eight[at[i] + 8 * k]), 27) * _P1 + _P4
    at, rest = at + rest // 8 * 8, rest % 8
    i = np.flatnonzero(rest >= 4)
    h[i] = _turned(h[i] ^ (four[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at, rest = at + rest // 4 * 4, rest % 4
    for k in range(3):
        i = np.flatnonzero(rest > k)
        h[i] = _turned(h[i] ^ (padded[at[i] + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))
