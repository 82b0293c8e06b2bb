"""Minimal perfect hashing of 256-bit digests, in numpy.

Level by level, every key left marks a place of a bit array twice as large as their number; a place that
one key alone marks is that key's, the others go on to the next level. The bit arrays follow each other, and a
key's slot is the number of places taken before its own, so n keys fill the slots 0 to n - 1. A key that
was not among them finds no place, or the slot of another: the caller compares the whole digest.
"""

from __future__ import annotations

import numpy as np

from boxoffice.llm.textkit import mix

ROOM = 2
_WORD, _STEP = 64, 0x9E3779B97F4A7C15


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each key (rows of four 64-bit words) among ``size`` of a level."""
    h = np.full(len(keys), (level + 1) * _STEP % (1 << 64), np.uint64)
    for k in range(keys.shape[1]):
        h = mix(h ^ keys[:, k])
    return (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct keys to the function: ``bits``, ``ranks`` (bits set before each word) and ``sizes``."""
    sizes, words, level = [], [], 0
    while len(keys):
        size = -(-ROOM * len(keys) // _WORD) * _WORD
        at = _places(keys, level, size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        keys, level = keys[~alone[at]], level + 1
    bits = np.concatenate([*words, np.zeros(0, np.uint64)])
    ranks = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
    return {"bits": bits, "ranks": ranks, "sizes": np.array(sizes, np.int64)}


def slots(function: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where it finds no place."""
    bits, ranks = function["bits"], function["ranks"]
    out, left, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(function["sizes"].tolist()):
        place = first + _places(keys[left], level, size)
        word, bit = place // _WORD, (place % _WORD).astype(np.uint64)
        here = (bits[word] >> bit) & np.uint64(1) == 1
        word, bit = word[here], bit[here]
        out[left[here]] = ranks[word] + np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        left, first = left[~here], first + size
    return out
