"""Hashed features of whole texts for the classifiers: words and word shapes, from bytes."""

from __future__ import annotations

import zlib

import numpy as np

_CLASS = bytearray(range(256))
for _b in range(65, 91):
    _CLASS[_b] = 65
for _b in range(97, 123):
    _CLASS[_b] = 97
for _b in range(128, 256):
    _CLASS[_b] = 97
for _b in range(48, 58):
    _CLASS[_b] = 57
CLASS = bytes(_CLASS)
#: Lower-case A-Z; ASCII characters that are neither letters nor digits become spaces.
WORD = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or b >= 97 and b < 123 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """Word to bucket, remembered up to a bound."""

    def __init__(self, n: int, seed: int = 0, bound: int = 200_000):
        super().__init__()
        self.n, self.seed, self.bound = n, seed, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.bound:
            self.clear()
        self[word] = i = zlib.crc32(word, self.seed) % self.n
        return i


def words(text: str | None) -> list[bytes]:
    """Lower-case words of letters and digits."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD).split()


def shapes(text: str | None) -> list[bytes]:
    """Each white-space word with its characters mapped to classes (A, a, 9, others as they are), runs collapsed."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(CLASS), np.uint8)
    if not raw.size:
        return []
    return raw[np.concatenate(([True], raw[1:] != raw[:-1]))].tobytes().split()
