"""Distinct word shingles of texts as 64-bit fingerprints, and parity sketches of such sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from boxoffice.llm.textkit import fingerprints, mix, text_bytes, words

_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and n + 1 offsets. A text with fewer than ``k``
    words has its whole sequence as one shingle; one without words has none."""
    low, starts, ends, at = words(*text_bytes(column))
    prints = fingerprints(low, starts, ends)
    count = np.diff(at)
    size = np.minimum(count, k)
    number = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
    owner = np.repeat(np.arange(len(count)), number)
    first = np.repeat(at[:-1] - (np.cumsum(number) - number), number) + np.arange(len(owner))
    h = size[owner].astype(np.uint64)
    for j in range(k):
        inside = j < size[owner]
        h = mix(h + np.where(inside, prints[np.minimum(first + j, max(len(prints) - 1, 0))], 0) * _FACTORS[j % len(_FACTORS)]) if len(prints) else h
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(count) + 1))


def overlaps(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the i-th sets of both sides."""
    n = len(left_at) - 1
    owner = np.concatenate([np.repeat(np.arange(n), np.diff(x)) for x in (left_at, right_at)])
    values = np.concatenate([left, right])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    same = (values[1:] == values[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][same], minlength=n)
