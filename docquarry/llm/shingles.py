"""Word shingles of whole texts as 64-bit hashes, for a batch at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from docquarry.llm.groups import text_buffers

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Octets of a word from which on it is hashed as a whole.
_LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_FOLDED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _hashed(octets: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Words mixed in blocks of eight octets, so that one of eight or fewer shares its hash with none of its length; long ones by BLAKE2b."""
    sizes = stops - starts
    out = mix(sizes.astype(np.uint64) * _BASE)
    for k in np.flatnonzero(sizes > _LONG).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(octets[starts[k] : stops[k]].tobytes(), digest_size=8).digest(), "<u8")[0]
    padded = np.r_[octets, np.zeros(8, np.uint8)]
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))  # the eight octets from each place on
    rest, at = np.flatnonzero(sizes <= _LONG), 0
    while len(rest):
        left = sizes[rest] - at
        value = eight[starts[rest] + at]
        short = left < 8
        value[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        out[rest] = mix((out[rest] ^ value) * _STEP)
        rest, at = rest[left > 8], at + 8
    return out


def word_hashes(octets: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each document); words are runs without ASCII white space, A-Z lower-cased with ``fold``."""
    if not len(octets):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_IS_SPACE[octets]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(octets)]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    del begins
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    ends = edges[edges > 0] - 1
    stops[ends] = solid[ends]
    stops = np.flatnonzero(stops) + 1
    return _hashed(_FOLDED[octets] if fold else octets, starts, stops), np.diff(np.searchsorted(starts, offsets))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` words in a row, across documents."""
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + words[k : len(words) - width + 1 + k]
    return mix(rolled)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted.

    A shingle is ``width`` words in a row; a text with fewer, but some, is one shingle of all its words;
    one without words has none.
    """
    octets, offsets = text_buffers(texts)
    words, counts = word_hashes(octets, offsets)
    rolled = windows(words, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            s = np.sort(rolled[at : at + n - width + 1])
            if len(s) > 1:
                s = s[np.r_[True, s[1:] != s[:-1]]]
        elif n:
            h = np.zeros(1, np.uint64)
            for w in words[at : at + n]:
                h = h * _STEP + w
            s = mix(h ^ np.uint64(n))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        at += n
    return out
