"""64-bit hashes of many byte ranges at once, with numpy.

A range's hash comes from prefix sums of mixed values times powers of an odd number, so any range costs two look-ups.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power 0..n-1 modulo 2**64, and the inverses."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ranges() takes hashes."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], dtype=U, out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


BYTES = mix(np.arange(1, 257, dtype=U))
WORDS_AT_ONCE = 1 << 16


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A hash of each word."""
    out = []
    for at in range(0, len(ws), WORDS_AT_ONCE):
        part = ws[at : at + WORDS_AT_ONCE]
        size = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(size)
        sums = prefix(BYTES[np.frombuffer(b"".join(part), np.uint8)])
        out.append(mix(ranges(sums, end - size, end) + size.astype(U)))
    return np.concatenate(out) if out else np.zeros(0, U)


def shingle_set(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; fewer words are one run."""
    n = len(word_hash)
    if n == 0:
        return word_hash
    k = min(size, n)
    total = np.full(n - k + 1, U(k), U)
    for j in range(k):
        total = mix(total + word_hash[j : n - k + 1 + j] * U(2 * j + 1))
    return np.unique(total)
