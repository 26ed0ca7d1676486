"""Word hashes and rolling window hashes, shared by the operators that compare word windows."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD_A = np.uint64(0x9E3779B97F4A7C15)
_ODD_B = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Rolling:
    """Hashes of all n-word windows in a few vector operations.

    With P[i] the sum of w[j] * b**-j for j < i (mod 2**64), a window's polynomial value is
    (P[i + n] - P[i]) * b**i, the same wherever the window stands.
    """

    def __init__(self, second: bool = False):
        self.base = int(_ODD_B if second else _ODD_A)
        self.second = second
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) >= n:
            return
        size = max(n, 4096, 2 * len(self._up))
        for name, base in (("_up", self.base), ("_down", _inverse(self.base))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def windows(self, hashes: np.ndarray, n: int) -> np.ndarray:
        count = len(hashes) - n + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        self._powers(len(hashes) + 1)
        w = mix(hashes + np.uint64(0x5851F42D4C957F2D)) if self.second else hashes
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(w * self._down[: len(w)], out=sums[1:])
        return mix((sums[n:] - sums[:count]) * self._up[:count])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
