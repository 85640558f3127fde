"""Word shingles as 64-bit hashes, made a whole text at a time."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import xxhash

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at the six ASCII white-space characters."""
    return text.encode().lower().split() if text else []


class _Hashes(dict):
    """Word to hash, filled on demand and emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hash_of = _Hashes().__getitem__


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash_of, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], k: int = 5) -> np.ndarray:
    """A hash for each k-word shingle in order of position; fewer words make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    return _windows(word_hashes(words), k)


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    s = h[:n] * _MIX[0]
    for j in range(1, k):
        s ^= s >> np.uint64(29)
        s *= _MIX[3]
        s += h[j : j + n] * _MIX[1] + np.uint64(j)
    s ^= s >> np.uint64(32)
    s *= _MIX[2]
    return s ^ (s >> np.uint64(29))


def shingle_sets(texts: Iterable[str | None], k: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text in ascending order; those of all texts are mixed together."""
    words = [words_of(t) for t in texts]
    h = np.fromiter(map(_hash_of, chain.from_iterable(words)), np.uint64, sum(map(len, words)))
    mixed = _windows(h, k) if len(h) >= k else h[:0]
    out, at = [], 0
    for w in words:
        if len(w) < k:
            out.append(shingle_hashes(w, k))
        else:
            s = np.sort(mixed[at : at + len(w) - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        at += len(w)
    return out
