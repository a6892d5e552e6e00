"""Vectorized hashes over the words of one text."""

from __future__ import annotations

import numpy as np

from casegraph.llm.common import mix64

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(size - 1, BASE, np.uint64)])
                self.down = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(size - 1, INVERSE, np.uint64)])
        return self.up[:n], self.down[:n]


def rolling(hashes: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """A hash of each `width` consecutive words: the polynomial of the words' hashes modulo 2^64, then mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.upto(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return mix64((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    low, span = values, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
