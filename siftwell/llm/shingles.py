"""Word shingles of a text as 64-bit numbers, computed with array arithmetic.

A stretch of bytes has the hash sum(T[b] * B^j) mod 2^64 with a random table T and an odd
base B; prefix sums give every shingle's hash at once.  A final mix spreads its bits.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (BASE, INVERSE))
        return self.up, self.down


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[: len(data)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = POWERS.upto(len(sums))
    return mixed((sums[end] - sums[begin]) * down[begin])


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct shingles of ``width`` words, sorted; of fewer words the whole sequence; of none nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    sums = prefix_sums(joined)
    gaps = np.flatnonzero(joined == 0x20)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    size = min(width, len(words))
    return np.unique(stretch_hashes(sums, begin[: len(words) - size + 1], end[size - 1 :]))


def alike(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|; empty sets are like nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
