"""Vectorised work on the texts of one Arrow batch: bytes, words, fingerprints and a memo table.

Texts are taken as UTF-8 bytes. Null texts count as empty. Fingerprints have 64 bits; two different
words share one with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A slice of a batch holds at most this many bytes of text, or one longer text.
SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, n + 1, at * 8)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most ``limit`` bytes in ``column``, or a single row."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        _, offsets = text_bytes(values)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over the whole width."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[k] = table
    return _powers


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each byte range; never 0."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    h[h == 0] = 1
    return h


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, cut at text ends, and the first run of each text."""
    n = len(inside)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside & (~before[:-1] | first[:-1])
    after = np.zeros(n, bool)
    if n:
        after[:-1] = inside[1:]
    stops = inside & (~after | first[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: the lower-cased bytes, starts, ends,
    and n + 1 offsets of the texts' words."""
    low = LOWER[data]
    starts, ends, at = runs(~SPACE[data], offsets)
    return low, starts, ends, at


class Memo:
    """An open-addressing table from non-zero 64-bit keys to 32-bit values, looked up in bulk."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is missing."""
        out = np.full(len(keys), -1, np.int32)
        left, slot, mask = None, self._slot(keys), (1 << self.bits) - 1
        while len(keys):
            there = self.keys[slot]
            hit = there == keys
            out[hit if left is None else left[hit]] = self.values[slot[hit]]
            more = np.flatnonzero(~hit & (there != 0))
            left = more if left is None else left[more]
            keys, slot = keys[more], (slot[more] + 1) & mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        while (self.size + len(keys)) * 2 > 1 << self.bits:
            full = self.keys != 0
            old = self.keys[full], self.values[full]
            self.__init__(self.bits + 1)
            self.add(*old)
        self.size += len(keys)
        values, slot, mask = values.astype(np.int32), self._slot(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = free & (self.keys[slot] == keys)
            self.values[slot[mine]] = values[mine]
            rest = ~mine
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & mask


def first_of_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the place of one occurrence of each."""
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    return ordered[head], order[head]


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
