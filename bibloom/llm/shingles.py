"""Hashed word shingles, MinHash signatures and the sequential test; the array helpers of near_dedup.py."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_WORD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _WORD, np.uint64))])


def word_hashes(text: str) -> np.ndarray:
    """A hash of each run of characters other than space and U+0009-U+000D, A-Z in lower case."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    at = np.nonzero(inside)[0]
    if not len(at):
        return np.zeros(0, np.uint64)
    letters = raw[at].astype(np.uint64)
    letters += ((letters >= 65) & (letters <= 90)).astype(np.uint64) << np.uint64(5)
    first = np.concatenate([[0], np.nonzero(at[1:] - at[:-1] > 1)[0] + 1])
    sizes = np.concatenate([first[1:], [len(at)]]) - first
    place = np.arange(len(at)) - np.repeat(first, sizes)
    powers = _powers(1 << max(10, int(sizes.max()).bit_length()))
    return mix(np.add.reduceat((letters + np.uint64(1)) * powers[place], first) + sizes.astype(np.uint64))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    joined = np.full(n, k, np.uint64)
    for i in range(k):
        joined = (joined ^ words[i : i + n]) * _STEP
        joined ^= joined >> np.uint64(29)
    found = mix(joined)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


@lru_cache(maxsize=4)
def _multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, count: int, seed: int) -> np.ndarray:
    """The least value of each of ``count`` multiplicative permutations, its high 32 bits."""
    a = _multipliers(count, seed)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * a).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = mix(key * _STEP ^ rows[:, i])
    return key.view(np.int64)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set."""
    with np.errstate(over="ignore"):
        a, b = mix(shingles, 0x51ED2701).sum(dtype=np.uint64), mix(shingles, 0x7FB5D329F).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


@lru_cache(maxsize=8)
def least_matches(count: int, batch: int, threshold: float, miss: float) -> tuple[int, ...]:
    """For each checkpoint n = batch, 2 batch, ...: the fewest matches m of n with which a pair stays.

    With a uniform prior the similarity's posterior is Beta(m + 1, n - m + 1); a pair goes
    when P(similarity >= threshold | m of n) < miss.
    """
    grid = (np.arange(200_000) + 0.5) / 200_000
    log, log1 = np.log(grid), np.log1p(-grid)
    upper = grid >= threshold
    out = []
    for n in range(batch, count + 1, batch):
        for m in range(n + 1):
            density = m * log + (n - m) * log1
            density = np.exp(density - density.max())
            if density[upper].sum() >= miss * density.sum():
                out.append(m)
                break
    return tuple(out)


def similar_enough(a: np.ndarray, b: np.ndarray, threshold_percent: int) -> bool:
    """100 * intersection >= threshold * union, of two sorted sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= threshold_percent * (len(a) + len(b) - shared)
