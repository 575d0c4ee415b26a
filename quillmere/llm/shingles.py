"""Word shingles as 64-bit numbers, for the operators that compare documents by them."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    """Lower-cased, parted at white space."""
    return text.lower().split()


def word_numbers(text: str) -> np.ndarray:
    """XXH64 of each word; hashing a word takes less time than a look into a cache that most words aren't in."""
    found = words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def rolled(w: np.ndarray, n: int) -> np.ndarray:
    """A number for each n words that follow one another; for one to n - 1 words, one number for them all."""
    if not len(w):
        return w
    size = min(n, len(w))
    count = len(w) - size + 1
    h = w[:count].copy()
    for k in range(1, size):
        h = h * ODD + w[k : k + count]
    return mixed(h + np.uint64(size))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted and distinct."""
    return np.unique(rolled(word_numbers(text), n))


def fingerprint(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Of ODD, and of its inverse; as long as the longest text so far.
_POWERS: list[np.ndarray] = [powers(ODD, 1 << 12), powers(np.uint64(pow(int(ODD), -1, 1 << 64)), 1 << 12)]


def window_hashes(w: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """A number for the ``size`` words from each place on: sums of numbers times powers, moved back to the power zero."""
    if len(w) > len(_POWERS[0]):
        _POWERS[:] = [powers(p[1], 2 * len(w)) for p in _POWERS]
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * _POWERS[0][: len(w)], out=sums[1:])
    return mixed((sums[at + size] - sums[at]) * _POWERS[1][at] + np.uint64(size))


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick of every ``width`` in a row, by doubling."""
    size = 1
    while 2 * size <= width:
        values, size = pick(values[:-size], values[size:]), 2 * size
    return pick(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Places of the least value of every ``width`` in a row, all of equal ones."""
    least = sliding(values, width, np.minimum)
    reach = np.zeros(len(least) + 2 * (width - 1), values.dtype)
    reach[width - 1 : width - 1 + len(least)] = least
    return np.flatnonzero(sliding(reach, width, np.maximum) == values)
