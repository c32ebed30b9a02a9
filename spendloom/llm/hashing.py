"""Hashes of words and of runs of words, in numpy, for code that runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a Python worker remembers.
KEPT_WORDS = 250_000


class WordHashes(dict):
    """64-bit hashes by word; a word is hashed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^i and base^-i modulo 2^64, i < n; base is odd."""
    if (found := _powers.get((base, n))) is not None:
        return found
    steps = np.full((2, n), base, np.uint64)
    steps[1] = pow(base, -1, 2**64)
    steps[:, 0] = 1
    _powers[base, n] = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _powers[base, n]


def runs(words: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of k words (polynomials from running sums, then mixed); of all words together if there
    are fewer, none if there are none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    up, down = powers(base, 1 << (n - 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.uint64(k))


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes made distinct: the second occurrence of a value differs from the first, and so on."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return hashes
    at = np.arange(len(hashes))
    nth = np.empty(len(hashes), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(nth > 0, mixed(hashes + nth * np.uint64(0x9E3779B97F4A7C15)), hashes)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
