"""Helpers shared by the training-data operators: word splitting, small hashes, memory of workers."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from ..scratch import discard, scratch_path, stored

__all__ = ["WordHashes", "discard", "isqrt_up", "mix", "scratch_path", "shingle_hashes", "stored", "tidy", "words_alnum", "words_letters", "words_plain"]

#: Bytes that end a word when punctuation counts as a separator: all ASCII but digits and letters.
_PUNCT = bytes(
    32 if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else (b + 32 if 65 <= b <= 90 else b)
    for b in range(256)
)
#: As above, with digits ending words too.
_LETTERS = bytes(32 if 48 <= b <= 57 else _PUNCT[b] for b in range(256))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving memory back at a task's end, as workers live on beside the tasks of later stages."""

    def call(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not with this C library
            pass

    return call


def words_plain(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: ``bytes.split`` ends words at just these."""
    return text.lower().split()


def words_alnum(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return text.translate(_PUNCT).split()


def words_letters(text: bytes) -> list[bytes]:
    """Like :func:`words_alnum`, but digits end words too."""
    return text.translate(_LETTERS).split()


class WordHashes(dict):
    """word -> 63-bit hash, remembered. Forgets all when it holds ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, shift, xor)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every run of ``k`` consecutive word hashes; empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0x100000001B3)
        out = (out ^ (out >> np.uint64(27))) + words[i : i + n]
    return mix(out)


def isqrt_up(n: int) -> int:
    """Smallest integer whose square is at least ``n``."""
    return math.isqrt(max(0, n - 1)) + 1 if n > 0 else 0
