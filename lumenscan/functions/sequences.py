"""Hashes of windows of a sequence of 64-bit values, by prefix sums: any window costs the same."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U64 = np.uint64
#: Odd multipliers, so that powers have inverses modulo 2^64; one finds equal windows, the other confirms them.
FIND, CONFIRM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, _U64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Windows:
    """values: int64. hash(start, size) for arrays of starts and sizes."""

    def __init__(self, values: np.ndarray, base: int = FIND):
        n = len(values)
        self.up, self.down = _powers(base, 1 << max(10, int(n).bit_length()))
        self.sums = np.zeros(n + 1, _U64)
        np.cumsum(scrambled(values.astype(np.int64).view(_U64) + _U64(base)) * self.up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return scrambled((self.sums[start + size] - self.sums[start]) * self.down[start] + size.astype(_U64))


def common(one: Windows, i: np.ndarray, two: Windows, j: np.ndarray) -> np.ndarray:
    """How long the sequences agree from i in one and from j in two."""
    room = np.minimum(len(one.sums) - 1 - i, len(two.sums) - 1 - j)
    least, most = np.zeros_like(room), room.copy()
    while (least < most).any():
        middle = (least + most + 1) // 2
        same = one.hash(i, middle) == two.hash(j, middle)
        least, most = np.where(same, middle, least), np.where(same, most, middle - 1)
    return least
