"""Hashes of many spans of bytes at once."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 5


def give_back() -> None:
    """Hand what freed arrays of a batch held back to the system: workers live on between stages, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class SpanHasher:
    """64-bit hashes of spans of one byte array, equal for equal spans of any array.

    A span's hash is the difference of two prefix sums of byte times power of an
    odd base, taken back to place 0 with the base's inverse modulo 2**64.
    """

    def __init__(self) -> None:
        self.power = np.ones(1, np.uint64)
        self.inverse = self.power

    def __call__(self, raw: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(raw):
            base = np.full(len(raw) + 1, BASE, np.uint64)
            base[0] = 1
            self.power = np.cumprod(base)
            base[1:] = pow(BASE, -1, 1 << 64)
            self.inverse = np.cumprod(base)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)])])
        return mixed((sums[until] - sums[at]) * self.inverse[at] + (until - at).astype(np.uint64))
