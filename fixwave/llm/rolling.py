"""Polynomial hashes of byte strings, modulo 2^64, for all positions of an array at once."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_up = _down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        one = np.ones(1, np.uint64)
        _up = np.cumprod(np.concatenate([one, np.full(n, BASE, np.uint64)]), dtype=np.uint64)
        _down = np.cumprod(np.concatenate([one, np.full(n, pow(BASE, -1, 2**64), np.uint64)]), dtype=np.uint64)
    return _up, _down


class Rolling:
    """Hashes of any stretch of ``data``; equal stretches have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """The hash of each stretch of ``size`` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread what differs over all bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def leftmost_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """For each i, where the least of x[i : i + width] first is."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, np.int32)
    value, at, have = x, np.arange(len(x), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        at = np.where(right, at[step:], at[:-step])
        value = np.where(right, value[step:], value[:-step])
        have += step
    return at[:n]
