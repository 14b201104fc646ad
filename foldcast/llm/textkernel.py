"""Vectorised word and rolling-hash kernels over the raw UTF-8 bytes of an Arrow batch.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are polynomials modulo 2**64 over random byte
values; as the base is odd it has an inverse, so the hash of any span is a difference of prefix sums times a power.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import flat_bytes

_random = np.random.default_rng(20240229)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and their inverses modulo 2**64; grown on demand and kept."""
    had = _POWERS.get(base)
    if had is None or len(had[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        had = _POWERS[base] = (out[0], out[1])
    return had[0][:n], had[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def blocks(n: int, size: int, window: int) -> list[tuple[int, int]]:
    """Ranges that together hold every run of ``window`` of n elements once: one, or, over twice ``size``, overlapping ones of ``size`` runs."""
    if n <= 2 * size:
        return [(0, n)]
    return [(lo, min(n, lo + size + window - 1)) for lo in range(0, max(1, n - window + 1), size)]


class Rolling:
    """Hashes of arbitrary spans of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The polynomial of [start, end), with its length mixed in."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(BASES[2]))


class Words:
    """Words of a column of texts: byte starts and ends, and per text the index of its first word (n + 1 entries)."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = flat_bytes(texts)
        data, offsets = self.data, self.offsets
        word = ~SEPARATOR[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return Rolling(BYTE_VALUE[self.data], BASES[0]).of(self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i:i+width]) for every i with a full window."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
