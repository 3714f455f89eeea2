"""Polynomial hashes of stretches of bytes, in numpy."""

from __future__ import annotations

import functools

import numpy as np


@functools.cache
def _rolling(which: int) -> tuple[np.ndarray, int, int]:
    """Random values of the bytes, an odd base and its inverse modulo 2**64."""
    rng = np.random.default_rng(20 + which)
    base = int(rng.integers(1, 2**62)) * 2 + 1
    return rng.integers(0, 2**64, 256, np.uint64), base, pow(base, -1, 2**64)


class Rolling:
    """Polynomial hashes of any stretch of a buffer, from sums over its prefixes."""

    def __init__(self, data: np.ndarray, which: int):
        table, base, inverse = _rolling(which)
        powers = np.full(len(data) + 1, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers[:-1], out=self.sums[1:])
        self.back = np.full(len(data) + 1, inverse, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def of(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        x = (self.sums[end] - self.sums[begin]) * self.back[begin]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))
