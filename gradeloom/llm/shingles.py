"""Word hashes and hashed runs of consecutive words, shared by near and substring dedup."""

from __future__ import annotations

import numpy as np
import xxhash

REMEMBERED = 250_000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """word (bytes) -> 128-bit hash as bytes; remembered, emptied when it holds ``REMEMBERED`` words."""

    def __missing__(self, word: bytes) -> bytes:
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of each word's hash."""
        if len(self) > REMEMBERED:
            self.clear()
        both = np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8").reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    h = a * _K1 + b
    h ^= h >> np.uint64(32)
    h *= _K2
    h ^= h >> np.uint64(29)
    return h


def runs(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; none if there are fewer words. Doubles the run length step by step."""
    n = len(w) - size + 1
    if n <= 0:
        return w[:0]
    done, out, power, span = 0, None, w, 1
    rest = size
    while rest:
        if rest & 1:
            out = power[: len(w) - span + 1] if out is None else joined(out[: len(w) - done - span + 1], power[done:])
            done += span
        rest >>= 1
        if rest:
            power = joined(power[: len(power) - span], power[span:])
            span *= 2
    return out[:n]


def shingle_set(words: list[bytes], hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    w = hashes.of(words)[0]
    return np.unique(runs(w, size)) if len(w) >= size else joined(runs(w, len(w)), np.array([len(w)], np.uint64))
