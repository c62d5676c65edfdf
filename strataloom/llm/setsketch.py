"""Word shingles and SetSketch registers of texts, in numpy.

A SetSketch register holds an exponentially spaced, truncated minimum: with h the smallest of the set's
exponentially distributed hash values, K = floor(1 - log_B(h)), held between 0 and Q + 1. Registers of a union
are the larger ones of its parts, so sketches merge; equal registers grow likelier with the Jaccard
similarity, so they can be banded; and counts of equal, larger and smaller registers of two sketches estimate
that similarity jointly, by likelihood.
"""

from __future__ import annotations

from math import log

import numpy as np
import xxhash

from .shared import remember

SHINGLE = 5
#: Registers, in bands of ROWS. Two sets of similarity s miss each other with chance (1 - s^ROWS)^(M / ROWS):
#: 7e-11 at 0.85, where links begin.
M, ROWS = 200, 5
#: Base of the spacing; near 1, so that equal registers mean equal minima, for about 1 in 100 others.
B = 1.02
Q = 60_000
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Further registers, of which the low eight bits are kept, for sharper estimates of candidates.
FINE = 512
_random = np.random.default_rng(20_240_229)
_MULTIPLY = (_random.integers(0, 1 << 32, M + FINE, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _random.integers(0, 1 << 32, M + FINE, np.uint64).astype(np.uint32)[:, None]
#: Distinct words whose hashes a Python worker remembers.
MEMORY_WORDS = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()
remember("words", _hashes.clear)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then words between blank, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence where it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    m = len(h) - n + 1
    key = np.full(m, n, np.uint64)
    for i in range(n):
        key = (key ^ h[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return np.unique(key)


def registers(hashes: np.ndarray, first: int = 0, count: int = M) -> np.ndarray:
    """Registers of a set, as unsigned 16-bit numbers; all 0 for the empty set."""
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    multiply, add = _MULTIPLY[first : first + count], _ADD[first : first + count]
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(low), 2048):
        v = low[None, i : i + 2048] * multiply
        v += add
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        np.minimum(least, v.min(axis=1), out=least)
    if not len(low):
        return np.zeros(count, np.uint16)
    # the smallest of n uniform values, as that of n exponential ones
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(h) / log(B)), 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit number per band of ROWS registers."""
    return np.array([xxhash.xxh3_64_intdigest(b.tobytes(), seed=i) for i, b in enumerate(regs.reshape(-1, ROWS))], np.uint64).view(np.int64)


def fine_registers(hashes: np.ndarray) -> np.ndarray:
    """Low bytes of the further registers: equal for a share of them that is at least the similarity."""
    return (registers(hashes, M, FINE) & 0xFF).astype(np.uint8)


def estimate(one: np.ndarray, other: np.ndarray, size_one: int, size_other: int) -> np.ndarray:
    """Jaccard similarity of most likelihood, given the sets' sizes; `other` may hold many sketches.

    With shares u and v of the sets' sizes, a register is larger in one with chance p(u - v J) and in the other
    with p(v - u J), p(x) = -log_B(1 - x (B - 1) / B), and equal otherwise. The likelihood is concave in J; its
    largest point is found by halving.
    """
    other = np.atleast_2d(other)
    more = (one[None, :] > other).sum(axis=1)
    less = (one[None, :] < other).sum(axis=1)
    same = M - more - less
    u = size_one / (size_one + np.atleast_1d(size_other).astype(float))
    v = 1 - u
    low, high = np.zeros(len(other)), np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip(x, 1e-12, 1)
        inside = 1 - x * (B - 1) / B
        return -np.log(inside) / log(B), (B - 1) / B / inside / log(B)

    for _ in range(40):
        j = (low + high) / 2
        p, dp = chance(u - v * j)
        q, dq = chance(v - u * j)
        slope = more * -v * dp / p + less * -u * dq / q + same * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2
