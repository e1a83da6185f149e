"""Hashes of words and of ranges of words, on arrays."""

from __future__ import annotations

from array import array

import numpy as np
import xxhash

#: Words handled at once, about: bounds the arrays of a task.
BATCH_WORDS = 120_000
#: Odd multipliers of the hashes.
MIX_1, MIX_2, STEP_1, STEP_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """word -> number, with two independent 64-bit hashes by number."""

    def __init__(self):
        super().__init__()
        self.a, self.b = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(word)
        self.a.append(h & (2**64 - 1))
        self.b.append(h >> 64)
        n = self[word] = len(self.a) - 1
        return n

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first hashes, second hashes, text number) of the words of all texts, one after the other."""
        if len(self) > 200_000:
            self.__init__()
            self.clear()
        of = np.array([self[w] for t in texts for w in t], np.int64)
        text = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
        return np.frombuffer(self.a, np.uint64)[of], np.frombuffer(self.b, np.uint64)[of], text


def prefix_hashes(h: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial hash, and the inverse powers that shift a range to the origin."""
    power = np.empty(len(h) + 1, np.uint64)
    power[0] = 1
    back = power.copy()
    power[1:] = np.uint64(step)
    back[1:] = np.uint64(pow(step, -1, 1 << 64))
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], dtype=np.uint64, out=sums[1:])
    return sums, back


def range_hashes(sums: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) of words, equal for equal contents."""
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
