"""Word shingles as 64-bit hashes, and MinHash signatures over them (numpy, inside tasks).

A word is a maximal run of Unicode word characters of the lower-cased text.  A
shingle is five words in a row; a text of one to four words has one shingle
of all its words; a text without words has none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np

WIDTH = 5
WORD = re.compile(r"\w+")
#: Words handled at once, so that memory follows the block and not the text.
BLOCK_WORDS = 100_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, b, _U))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def hash_words(words: list[str]) -> np.ndarray:
    """A 64-bit polynomial hash per word, over its UTF-8 bytes."""
    if not words:
        return np.empty(0, _U)
    data = np.frombuffer((" ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    up, down = _power_tables(len(data))
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * up[:len(data)])])
    return mix((total[ends] - total[starts]) * down[starts])


def word_blocks(text: str) -> Iterator[list[str]]:
    text = text.lower()
    if len(text) <= 1 << 20:
        yield WORD.findall(text)
        return
    found = (m.group() for m in WORD.finditer(text))
    while block := list(islice(found, BLOCK_WORDS)):
        yield block


def shingle_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Shingle hashes of a whole text in blocks, in order, repeated ones too."""
    tail, some = np.empty(0, _U), False
    for block in word_blocks(text or ""):
        h = np.concatenate([tail, hash_words(block)])
        if len(h) >= WIDTH:
            n, acc, some = len(h) - WIDTH + 1, np.zeros(len(h) - WIDTH + 1, _U), True
            for k in range(WIDTH):
                acc = mix(acc * _U(_BASE) + h[k:k + n])
            yield acc
        tail = h[-(WIDTH - 1):]
    if not some and len(tail):
        yield mix(np.array([int(sum(int(x) * _BASE ** (k + 1) for k, x in enumerate(tail))) & (1 << 64) - 1], _U))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    parts = [np.unique(x) for x in shingle_hashes(text)]
    return np.empty(0, _U) if not parts else parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def digest(values: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


class MinHash:
    """`size` minimum hashes (32 bits each) by multiply-add-shift functions."""

    def __init__(self, size: int, seed: int = 20240):
        rng = np.random.default_rng(seed)
        self.size = size
        self.a = rng.integers(0, 1 << 63, size, dtype=_U) * _U(2) + _U(1)
        self.b = rng.integers(0, 1 << 63, size, dtype=_U)

    def signature(self, values: np.ndarray) -> np.ndarray:
        out = np.full(self.size, (1 << 32) - 1, _U)
        for k in range(0, len(values), 512):
            out = np.minimum(out, ((values[k:k + 512, None] * self.a + self.b) >> _U(32)).min(axis=0))
        return out.astype(np.uint32)
