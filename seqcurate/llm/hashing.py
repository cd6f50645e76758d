"""Vectorised hashing of words and character n-grams; used inside tasks."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of BASE modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n at least; kept, grown by doubling."""
    if len(_POWERS[0]) < n:
        size = 1 << max(14, int(n - 1).bit_length())
        for at, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[at] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def word_bounds(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of anything but blank, tab, line feed, VT, FF and CR."""
    inside = np.zeros(len(cp) + 2, np.int8)
    inside[1:-1] = (cp != 32) & ((cp < 9) | (cp > 13))
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given stretches; equal stretches have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(cp: np.ndarray, n: int) -> np.ndarray:
    """32-bit hashes of all runs of ``n`` code points."""
    if len(cp) < n:
        return np.zeros(0, np.uint32)
    out = cp[: len(cp) - n + 1].astype(np.uint32) + np.uint32(n)
    for k in range(1, n):
        out *= np.uint32(0x9E3779B1)
        out += cp[k : len(cp) - n + 1 + k]
        out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    return out
