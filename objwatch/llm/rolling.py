"""Hashes of all stretches of a sequence from prefix sums, modulo 2^64."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of an odd number, and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n * 5 // 4, base))])
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)
