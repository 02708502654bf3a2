"""64-bit hashes of words and of runs of words, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_ROUNDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One hash a word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the others (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` (up to 8) consecutive words, from the words' hashes."""
    k = len(h) - n + 1
    return joined([h[j:j + k] for j in range(n)]) if k > 0 else np.zeros(0, np.uint64)


def joined(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of up to 8 columns of hashes."""
    out = columns[0] * _ROUNDS[0]
    for x, r in zip(columns[1:], _ROUNDS[1:]):
        out += x * r
    return mix(out)
