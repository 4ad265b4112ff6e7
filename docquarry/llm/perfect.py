"""Minimal perfect hashing of 128-bit keys, by cascaded bit arrays (Limasset et al. 2017), for whole arrays at a time.

Level by level the keys that are alone at their place set a bit there; the others go on to the next, smaller level. A key's
number is the count of bits before its own, so n keys have the numbers 0 to n - 1. It takes about 3.7 bits a key.
"""

from __future__ import annotations

import numpy as np

from docquarry.llm.shingles import mix

_GAMMA = 2.0  # places of a level for each key that it is given
_WORD = 64


def _places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = mix(np.array([level + 1], np.uint64))
    return mix(high + mix(low ^ seed)) % np.uint64(size)


def build(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size of each level in bits, the levels' bits as 64-bit words) for distinct keys (``high``, ``low``)."""
    sizes, words = [], []
    while len(high):
        size = -(-int(_GAMMA * len(high) + 1) // _WORD) * _WORD
        at = _places(high, low, len(sizes), size)
        alone = (np.bincount(at.astype(np.int64), minlength=size) == 1)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        rest = ~alone[at.astype(np.int64)]
        high, low = high[rest], low[rest]
    return np.array(sizes, "<i8"), np.concatenate(words) if words else np.zeros(0, "<u8")


class PerfectHash:
    """Numbers of the keys that it was built of; any other key gets some number or -1, which a fingerprint has to refute."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.tolist(), words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.full(len(high), -1, np.int64)
        rest, base = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = _places(high[rest], low[rest], level, size) + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            lower = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[rest[hit]] = self.before[word[hit]] + np.bitwise_count(lower)
            rest, base = rest[~hit], base + size
        return out
