"""Elias-Fano sequences: monotone integers in about 2 + log2(universe / n) bits each.

The low bits of all values lie side by side; the high parts are gaps in unary code. A count of ones
before each block of 512 bits (32 bits a block) finds the k-th one or zero without a table of
positions. All lookups work on whole arrays. Parts are plain arrays and may be memory-mapped.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
#: The place of the k-th set bit in a byte.
_IN_BYTE = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    for _k, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _IN_BYTE[_byte, _k] = _bit
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_PACK = 1 << 16


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, side by side, as 64-bit words with one word to spare."""
    parts = []
    shifts = np.arange(width, dtype=np.uint64)
    for at in range(0, len(values) if width else 0, _PACK):
        bits = (values[at : at + _PACK, None] >> shifts & np.uint64(1)).astype(np.uint8)
        parts.append(np.packbits(bits.reshape(-1), bitorder="little"))
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return np.append(data, np.zeros(16 - len(data) % 8, np.uint8)).view(np.uint64)


def unpack_bits(packed: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    bit = index.astype(np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    value = packed[word] >> shift
    value |= (packed[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
    return value & np.uint64((1 << width) - 1)


def _place(counts: np.ndarray, left: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In which of eight parts the ``left``-th bit is, and how many of that part's bits are before it."""
    upto = np.cumsum(counts, axis=1, dtype=np.int16)
    part = (upto <= left[:, None]).sum(axis=1)
    return part, left - (upto[each, part] - counts[each, part])


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit of each 64-bit word. The eight bytes are counted side by side."""
    sums = word - (word >> np.uint64(1) & np.uint64(0x5555555555555555))
    sums = (sums & np.uint64(0x3333333333333333)) + (sums >> np.uint64(2) & np.uint64(0x3333333333333333))
    sums = (sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)
    upto = sums * np.uint64(0x0101010101010101)
    tops = np.uint64(0x8080808080808080)
    skipped = np.bitwise_count(((k * np.uint64(0x0101010101010101) | tops) - upto) & tops).astype(np.uint64) * np.uint64(8)
    left = k - ((upto << np.uint64(8)) >> skipped & np.uint64(0xFF))
    return skipped.astype(np.int64) + _IN_BYTE[word >> skipped & np.uint64(0xFF), left]


class EliasFano:
    """``values`` must not fall. ``parts()`` and ``EliasFano.of(parts)`` give it away and take it back."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values).astype(np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.width = max(0, (top // n).bit_length() - 1) if n else 0
        self.low = pack_bits(values, self.width)
        high = (values >> np.uint64(self.width)).astype(np.int64) + np.arange(n)
        size = (top >> self.width) + n + 1
        words = -(-size // BLOCK) * (BLOCK // 64)
        if words * 64 >= 1 << 32:
            raise ValueError("too long a sequence; write more files")
        bits = np.zeros(words * 8, np.uint8)
        np.bitwise_or.at(bits, high >> 3, np.uint8(1) << (high & 7).astype(np.uint8))
        self._set(bits, size - n)
        counts = _ONES[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64) if words else np.zeros(0, np.uint64)
        self.before = np.append(np.uint64(0), np.cumsum(counts, dtype=np.uint64)).astype(np.uint32)

    def _set(self, bits: np.ndarray, zeros: int) -> None:
        self.bits, self.zeros = bits, zeros
        self._words = bits.view(np.uint64)
        self._gaps: np.ndarray | None = None

    def parts(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.width, self.zeros], np.uint64), "low": self.low, "bits": self.bits, "before": self.before}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        self = cls.__new__(cls)
        self.n, self.width, zeros = map(int, parts["head"])
        self.low, self.before = parts["low"], parts["before"]
        self._set(parts["bits"], zeros)
        return self

    def nbytes(self) -> int:
        return sum(p.nbytes for p in self.parts().values())

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The bit position of the k-th (from 0) one or zero."""
        if not ones and self._gaps is None:
            self._gaps = np.arange(len(self.before), dtype=np.int64) * BLOCK - self.before
        before = self.before if ones else self._gaps
        block = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        left = k - before[block].astype(np.int64)
        rows = self._words.reshape(-1, BLOCK // 64)[block]
        if not ones:
            rows = ~rows
        each = np.arange(len(k))
        word, left = _place(np.bitwise_count(rows), left, each)
        return block * BLOCK + word * 64 + _select_in_word(rows[each, word], left.astype(np.uint64))

    def _run(self, position: np.ndarray) -> np.ndarray:
        """How many ones follow from each bit position on, 64 at most."""
        word, shift = position >> 6, (position & 63).astype(np.uint64)
        window = self._words[np.minimum(word, len(self._words) - 1)] >> shift
        following = self._words[np.minimum(word + 1, len(self._words) - 1)]
        following = np.where(word + 1 < len(self._words), following, 0)
        window |= (following << np.uint64(1)) << (np.uint64(63) - shift)
        window = np.where(word < len(self._words), window, 0)
        return np.bitwise_count(window & ~(window + np.uint64(1)) & (window ^ (window + np.uint64(1)))).astype(np.int64)

    def _range(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose values have the high part of each x; both n where all are smaller."""
        high = (x >> np.uint64(self.width)).astype(np.int64)
        beyond = high >= self.zeros
        high = np.where(beyond, 0, high)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)
        low, run = begin - high, self._run(begin)
        long = np.flatnonzero(run >= 63)
        run[long] = self._select(high[long], False) - begin[long]
        top = low + run
        return np.where(beyond, self.n, low), np.where(beyond, self.n, top)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place with at least x among those with its high part, and their end. Only low
        bits are compared."""
        low, end = self._range(x)
        top, goal = end.copy(), x & np.uint64((1 << self.width) - 1)
        open_ = np.flatnonzero(low < top)
        while len(open_):
            middle = (low[open_] + top[open_]) >> 1
            less = unpack_bits(self.low, self.width, middle) < goal[open_]
            low[open_[less]], top[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[low[open_] < top[open_]]
        return low, end

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        index = np.asarray(index, np.int64)
        high = (self._select(index, True) - index).astype(np.uint64)
        return high << np.uint64(self.width) | unpack_bits(self.low, self.width, index)

    def all(self) -> np.ndarray:
        """All values, in blocks."""
        out = np.empty(self.n, np.uint64)
        at = 0
        for block in range(0, len(self.bits), 1 << 16):
            ones = np.flatnonzero(np.unpackbits(self.bits[block : block + (1 << 16)], bitorder="little"))
            index = np.arange(at, at + len(ones))
            high = (ones + block * 8 - index).astype(np.uint64)
            out[index] = high << np.uint64(self.width) | unpack_bits(self.low, self.width, index)
            at += len(ones)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is at least x; n where there is none. The high part of x names a
        short range, which is then searched by halves."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        return self._search(np.asarray(x).astype(np.uint64))[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is x; -1 where there is none."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        x = np.asarray(x).astype(np.uint64)
        place, end = self._search(x)
        inside = np.flatnonzero(place < end)
        hit = unpack_bits(self.low, self.width, place[inside]) == x[inside] & np.uint64((1 << self.width) - 1)
        out = np.full(len(x), -1, np.int64)
        out[inside[hit]] = place[inside[hit]]
        return out
