"""Words and word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5

# Odd multipliers that tell the places of a shingle's words apart, and the constants of the splitmix64 finaliser.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser, which spreads every bit over the word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX1
        h = (h ^ (h >> np.uint64(27))) * _MIX2
        return h ^ (h >> np.uint64(31))


def ascii_words(text: bytes) -> list[bytes]:
    """Runs without ``[\\x20\\x09-\\x0D]``, A-Z lower-cased."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words are one shingle, none are none."""
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64) if words else np.zeros(0, np.uint64)
    h, n = word_hashes(words), len(words) - SHINGLE + 1
    with np.errstate(over="ignore"):
        total = sum((h[k : k + n] * _PLACE[k] for k in range(1, SHINGLE)), h[:n] * _PLACE[0])
    return np.unique(mix(total))
