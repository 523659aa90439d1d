"""Words and shingle hashes of whole texts: A-Z in lower case, words split at ASCII white space."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
KEPT = 200_000
_words: dict[bytes, int] = {}


def words(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII only: A-Z, and the white space x20 x09-x0D."""
    return text.encode().lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes; those of the first KEPT words that a worker sees are kept."""
    if len(_words) < KEPT:
        for w in set(tokens):
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
    known, h = _words, xxhash.xxh3_64_intdigest
    return np.fromiter((known[w] if w in known else h(w) for w in tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(tokens: list[bytes], k: int) -> np.ndarray:
    """One for each window of k words, in order; with fewer words, the whole sequence is the one shingle."""
    if not tokens:
        return np.empty(0, np.uint64)
    h = word_hashes(tokens)
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out * _MIX + h[i : len(h) - k + 1 + i])
    return out
