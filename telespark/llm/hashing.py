"""Hashes of byte substrings with numpy: one pass over a text, then any substring's
64-bit hash in constant time."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
# a random 64-bit value per byte
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of each 64-bit value over all of them."""
    h = h ^ (h >> _HALF)
    h *= _MULTIPLY
    h ^= h >> _HALF
    return h


class Substrings:
    """Substring hashes: sums of byte values times powers of an odd base, modulo 2^64.
    The tables of powers grow to the longest text seen."""

    def __init__(self):
        self.size = 0
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        def powers(base):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            return np.multiply.accumulate(p)
        self.size, self.power, self.inverse = size, powers(_BASE), powers(_INVERSE)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a text's bytes, len + 1 values."""
        n = len(data)
        if n > self.size:
            self._grow(1 << n.bit_length())
        out = np.empty(n + 1, np.uint64)
        out[0] = 0
        values = _BYTES[data]
        values *= self.power[:n]
        np.cumsum(values, out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), not mixed."""
        return (prefix[end] - prefix[start]) * self.inverse[start]

    def sliding(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all k-byte substrings, mixed."""
        h = prefix[k:] - prefix[:-k]
        h *= self.inverse[:len(h)]
        return mix(h)
