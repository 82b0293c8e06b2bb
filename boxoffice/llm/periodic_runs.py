"""Runs of repeated words, found online by catchers of squares over completed power-of-two blocks.

A square is a stretch of words followed by itself; overlapping squares of one period merge into a run.
Words are appended to a stream. Whenever a block of L = 2^k words that begins at a multiple of L is
complete, a catcher of that block waits for the block to come again 2 L to 4 L - 1 words later: a window of
one such period holds a whole block, so no square is missed, and an appended word ends a copy of at most
two blocks of a size. A copy opens a comparison of the words around the block with those one period
later. It is extended to the left at once and to the right as far as words have been appended; what still
agrees at the last word stays open and goes on with the next append. Words that repeat at once, and at
periods 2 and 3, are caught by single words.

Words are appended many at a time and handled in numpy. Blocks are told apart by 64-bit names, each the
mixture of the names of its two halves; extensions are found by prefix sums and then checked word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boxoffice.llm.batches import small_batches
from boxoffice.llm.textkit import SPACE, _power_tables, fingerprints, mix, runs as byte_runs, slices, text_bytes

#: A run is at least so many periods and so many words long.
TIMES, LEAST = 4, 6
#: Words of a stream are appended so many at a time, and half of what is there already where that is more:
#: a large block then costs no more than the words appended with it.
APPEND = 1 << 16
_HALF = np.uint64(0x9FB21C651E98DF25)


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a larger one with its values."""
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class Catchers:
    """The state of a stream of words: its words, the names of complete blocks, open comparisons and
    the runs found. ``append`` takes more words, ``runs`` gives what the stream holds so far."""

    def __init__(self, times: int = TIMES, least: int = LEAST):
        if times < 2:
            raise ValueError("a run has at least two periods")
        self.times, self.least, self.n = times, least, 0
        self.words, self.sums = np.zeros(0, np.uint64), np.zeros(1, np.uint64)
        self.blocks: list[np.ndarray] = []
        self.complete: list[int] = []
        self.open = np.zeros((0, 2), np.int64)
        self.closed: list[np.ndarray] = []

    def append(self, new: np.ndarray, place: np.ndarray) -> None:
        """``new``: words as 64-bit values; ``place``: how many words of its own text stand before each.
        Texts are kept apart by a word that comes once."""
        begin, end = self.n, self.n + len(new)
        self.words, self.sums = _grown(self.words, end), _grown(self.sums, end + 1)
        self.words[begin:end] = new
        up, _ = _power_tables(end + 1)
        np.cumsum(mix(new) * up[begin:end], out=self.sums[begin + 1 : end + 1])
        self.sums[begin + 1 : end + 1] += self.sums[begin]
        self.n = end
        found = self._extend(self.open[:, 0], self.open[:, 1], begin, np.zeros((0, 4), np.int64))
        for i, p in self._copies(begin, place):
            found = self._extend(i, p, i + p, found)
        found = found[:, :3]
        is_open = found[:, 1] == end
        # An open one is taken up where it began; a closed one counts if it is long enough.
        self.open = found[is_open][:, [0, 2]]
        self.closed.append(self._long(found[~is_open]))

    def _copies(self, begin: int, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, p): the block at i comes again at i + p, and the copy was completed by the last append.
        Of neighbouring blocks with one period the first is given."""
        at = np.arange(begin, self.n)
        one = at[place >= 1]
        hit = one[self.words[one] == self.words[one - 1]]
        yield self._first_of_each(hit - 1, np.ones(len(hit), np.int64), 1)
        size, level = 1, 0
        low = begin  # the copies that end in the append begin here
        names = self.words[low : self.n]
        while len(at):
            self._complete(level, size, low, names)
            # Places of words whose text reaches back far enough for the least period of this size.
            at = at[place[at - begin] + 1 - size >= 2 * size]
            first = at + 1 - size
            blocks, mine = self.blocks[level], names[first - low]
            near = first // size - 2
            hits, periods = [], []
            for back in (0, 1):
                block = near - back
                hit = (block >= 0) & (blocks[np.maximum(block, 0)] == mine)
                hits.append(block[hit] * size)
                periods.append(first[hit] - hits[-1])
            yield self._first_of_each(np.concatenate(hits), np.concatenate(periods), size)
            # Names of blocks twice as long, from those that begin a little earlier.
            before = max(low - size, 0)
            names = np.concatenate([self._names(level, size, before, low), names])
            names = mix(names[:-size] * _HALF + names[size:]) if len(names) > size else names[:0]
            low, size, level = before, 2 * size, level + 1

    def _names(self, level: int, size: int, low: int, high: int) -> np.ndarray:
        """The names of the ``size`` words from each of the places [low, high), halves first."""
        names = self.words[low : min(high + size - 1, self.n)]
        for k in range(level):
            names = mix(names[: -(1 << k)] * _HALF + names[1 << k :])
        return names[: high - low]

    def _complete(self, level: int, size: int, low: int, names: np.ndarray) -> None:
        """Keep the names of the blocks that are complete now."""
        if level == len(self.blocks):
            self.blocks.append(np.zeros(0, np.uint64))
            self.complete.append(0)
        blocks = self.blocks[level]
        there, total = self.complete[level], self.n // size
        if total > there:
            blocks = self.blocks[level] = _grown(blocks, total)
            at = np.arange(there, total) * size
            if at[0] < low:
                names, low = np.concatenate([self._names(level, size, at[0], low), names]), at[0]
            blocks[there:total] = names[at - low]
            self.complete[level] = total

    @staticmethod
    def _first_of_each(i: np.ndarray, p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((i, p))
        i, p = i[order], p[order]
        follows = np.zeros(len(i), bool)
        follows[1:] = (p[1:] == p[:-1]) & (i[1:] == i[:-1] + size)
        return i[~follows], p[~follows]

    def _extend(self, i: np.ndarray, p: np.ndarray, to, found: np.ndarray) -> np.ndarray:
        """Rows (start, end, p, i): those ``found``, and the longest stretches of period p around word
        i, which equals word i + p; the words before ``to`` are known to agree."""
        if not len(i):
            return found
        to = np.broadcast_to(to, i.shape)
        right, left = self._agree(to - p, to, forward=True), self._agree(i, i + p, forward=False)
        spans = np.concatenate([found, np.stack([i - left, to + right, p, i], 1)])
        spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
        # Of one stretch, multiples of its least period say nothing more.
        head = np.ones(len(spans), bool)
        head[1:] = (spans[1:, :2] != spans[:-1, :2]).any(1)
        least = spans[head, 2][np.cumsum(head) - 1]
        spans = spans[head | (spans[:, 2] % least != 0)]
        # Prefix sums can deceive for texts made to do so; words cannot.
        for k in np.flatnonzero(~self._holds(spans[:, :3])):
            spans[k, :3] = self._by_words(int(spans[k, 3]), int(spans[k, 2]))
        return spans

    def _agree(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from a and from b on agree (or up to them, not ``forward``); a < b."""
        _, down = _power_tables(self.n + 1)
        limit = self.n - b if forward else a
        got = np.zeros(len(a), np.int64)
        step = 1 << int(limit.max(initial=0)).bit_length()
        while step := step >> 1:
            more = np.flatnonzero(got + step <= limit)
            x, y = (a[more] + got[more], b[more] + got[more]) if forward else (a[more] - got[more] - step, b[more] - got[more] - step)
            same = (self.sums[x + step] - self.sums[x]) * down[x] == (self.sums[y + step] - self.sums[y]) * down[y]
            got[more[same]] += step
        return got

    def _holds(self, spans: np.ndarray) -> np.ndarray:
        """Whether all words of a span equal those one period on."""
        start, end, p = spans.T
        size = end - start - p
        out = np.ones(len(spans), bool)
        for top in _cuts(size, 1 << 20):
            rows = np.arange(*top)
            owner = np.repeat(rows, size[rows])
            x = np.repeat(start[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(len(owner))
            out[owner[self.words[x] != self.words[x + p[owner]]]] = False
        return out

    def _by_words(self, i: int, p: int) -> list[int]:
        unequal = self.words[: self.n - p] != self.words[p : self.n]
        right, left = np.flatnonzero(unequal[i:]), np.flatnonzero(unequal[:i])
        return [left[-1] + 1 if len(left) else 0, (i + right[0] if len(right) else self.n - p) + p, p]

    def _long(self, spans: np.ndarray) -> np.ndarray:
        size = spans[:, 1] - spans[:, 0]
        return spans[size >= np.maximum(self.least, self.times * spans[:, 2])]

    def runs(self) -> np.ndarray:
        """Rows (start, end, period), ascending. A run of several periods counts by the smallest."""
        still = np.stack([self.open[:, 0], np.full(len(self.open), self.n), self.open[:, 1]], 1)
        spans = np.unique(np.concatenate([*self.closed, self._long(still), np.zeros((0, 3), np.int64)]), axis=0)
        head = np.ones(len(spans), bool)
        head[1:] = (spans[1:, :2] != spans[:-1, :2]).any(1)
        spans = spans[head]
        return spans[np.lexsort((spans[:, 2], spans[:, 0]))]


def _cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` in all."""
    if len(sizes):
        marks = np.flatnonzero(np.diff(np.cumsum(sizes) // limit, prepend=-1))
        yield from zip(marks.tolist(), [*marks[1:].tolist(), len(sizes)], strict=True)


def runs_of_texts(words: np.ndarray, at: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, end, period) for words of several texts; ``at``: n + 1 offsets."""
    n = len(at) - 1
    count = np.diff(at)
    alone = mix(np.arange(n, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    stream = np.insert(words, at[1:], alone)
    begins = at[:-1] + np.arange(n)
    place = np.arange(len(stream)) - np.repeat(begins, count + 1)
    state, done = Catchers(times, least), 0
    while done < len(stream):
        to = min(len(stream), done + max(APPEND, done // 2))
        state.append(stream[done:to], place[done:to])
        done = to
    runs = state.runs()
    text = np.searchsorted(begins, runs[:, 0], "right") - 1
    return np.column_stack([text, runs[:, 0] - begins[text], runs[:, 1] - begins[text], runs[:, 2]])


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, runs: np.ndarray) -> pa.Array:
    """The texts without the words that repeat a period, words joined by single spaces."""
    steps = np.zeros(len(starts) + 1, np.int64)
    first = at[runs[:, 0]]
    np.add.at(steps, first + runs[:, 1] + runs[:, 3], 1)
    np.add.at(steps, first + runs[:, 2], -1)
    kept = np.cumsum(steps[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(kept)])[at]
    starts, sizes = starts[kept], (ends - starts)[kept] + 1
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(out_at[-1]) + np.repeat(starts - out_at[:-1], sizes)
    out = np.append(data, np.uint8(32))[source]
    out[out_at[1:] - 1] = 32
    # A text ends before the space after its last word.
    low, high = out_at[upto[:-1]], out_at[upto[1:]]
    whole = [out[a : max(b - 1, a)].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    return pa.array(whole, pa.binary())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """Per row: ``id_col``, runs (an array of start, length and period in words, ascending) and collapsed
    (the text without the words that any run holds after its first period, joined by single spaces).

    Words are runs of other bytes than white space, compared as they stand. A run is a stretch of words
    with smallest period q, at least ``least`` words and ``times`` q long, that no neighbouring word
    extends. Null and empty texts have no runs and an empty collapsed text. Repeated and null ids are
    rows like others. Words are compared by 64-bit fingerprints. A text is handled whole by one task,
    which holds some 40 bytes a word.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column(1))
            starts, ends, at = byte_runs(~SPACE[data], offsets)
            found = runs_of_texts(fingerprints(data, starts, ends), at, times, least)
            lists = np.searchsorted(found[:, 0], np.arange(part.num_rows + 1))
            values = pa.StructArray.from_arrays([pa.array(found[:, 1]), pa.array(found[:, 2] - found[:, 1]), pa.array(found[:, 3])], ["start", "length", "period"])
            text = _collapsed(data, starts, ends, at, found).cast(pa.string())
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), values), text], names=["id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        out = rows.mapInArrow(make, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.select(F.col("id").alias(id_col), "runs", "collapsed")


def repeated_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and text, where one document in ten gets a periodic tail: with h the crc32 of the id as
    text and g = floor(h / 10), if h % 10 = 0 the word i >= a becomes the word a + (i - a) % p, where
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Texts without words and rows without an id stay."""
    h = F.crc32(F.col("_id").cast("string"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_h", h)
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("_text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)))
    rows = rows.withColumn("_words", words).withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_n", F.size("_words"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    tail = "array_join(transform(sequence(0, _n - 1), i -> _words[if(i < _a, i, _a + (i - _a) % _p)]), ' ')"
    return rows.select(F.col("_id").alias(id_col), F.when(F.col("_n") > 0, F.expr(tail)).otherwise(F.col("_text")).alias("text"))


def run_digests(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the registered query out of ``periodic_runs`` of documents with periodic tails."""
    found = periodic_runs(repeated_tail(docs, id_col), id_col, "text")
    # The longest run, of equally long ones the first, then that of the smaller period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("within"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    return rows.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.within")).alias("period"),
        F.expr("1000 * best.length div -best.within").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
