"""Hashed n-grams of byte buffers in numpy: polynomial hashes in wrapping arithmetic, mixed and cut to a number of buckets."""

from __future__ import annotations

import numpy as np

P = np.uint32(0x01000193)
_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def mix(h: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of hashes: 32-bit finalisation, then the highest bits."""
    h = h ^ (h >> np.uint32(16))
    h *= _M1
    h ^= h >> np.uint32(13)
    h *= _M2
    return h >> np.uint32(32 - bits)


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place on; len(data) - n + 1 of them."""
    size = max(0, len(data) - n + 1)
    h = np.full(size, n, dtype=np.uint32)
    wide = data.astype(np.uint32)
    for k in range(n):
        h *= P
        h += wide[k : k + size]
    return h


def spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of data, by sums of powers in wrapping 64-bit arithmetic."""
    n = len(data)
    power = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    # Dividing by a power is multiplying by the inverse's power, so equal spans hash alike wherever they stand.
    h = (total[end] - total[begin]) * inverses(n)[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _TABLES.get(base)
    if got is None or len(got) < n + 1:
        size = 1 << max(16, int(n + 1).bit_length())
        got = np.ones(size, dtype=np.uint64)
        have = 1
        while have < size:
            got[have : 2 * have] = got[:have] * np.uint64(pow(base, have, 1 << 64))
            have *= 2
        _TABLES[base] = got
    return got


def powers(n: int) -> np.ndarray:
    return _powers(_BASE, n)


def inverses(n: int) -> np.ndarray:
    return _powers(_INVERSE, n)
