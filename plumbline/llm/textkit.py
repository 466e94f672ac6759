"""Vectorised word and shingle hashing on single texts (NumPy only, no Spark)."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import remembers

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MAX_WORDS = 1 << 18


class _Hashes(dict):
    """Word to 64-bit hash; forgets everything once it holds a quarter of a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()
remembers(_hashes.clear)
_powers = {"b": np.ones(1, U), "i": np.ones(1, U)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), U, len(words))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["b"]) < n:
        m = max(n, 2 * len(_powers["b"]))
        for key, base in (("b", _BASE), ("i", _BASE_INV)):
            p = np.full(m, base, U)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=U)
    return _powers["b"][:n], _powers["i"][:n]


def rolling(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words: a polynomial modulo 2**64, then mixed."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, U)
    p, inv = _pow(len(w))
    s = np.zeros(len(w) + 1, U)
    np.cumsum(w * inv, dtype=U, out=s[1:])
    return mix64((s[k:] - s[:-k]) * p[:n])


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words count as one shingle, none as none."""
    if not words:
        return np.empty(0, U)
    w = word_hashes(words)
    return np.unique(rolling(w, min(k, len(w))))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    if len(x) < width:
        return np.empty(0, x.dtype)
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted array."""
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_set, x)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == x
