"""An n-gram trie of two levels in Elias-Fano files, and scoring of texts with it.

Level 1 has the words in the order of their fingerprints; a word's number is its place. Level 2 has,
for each word as context, its successors: monotone pointers say where a context's successors begin,
and the successors' numbers, counted on from the last one of the context before, are one monotone
sequence, searched relative to the context. Each successor has its smoothed probability in a few bits.
All files are cut by ranges of words and memory-mapped where they are used.

Smoothing: p(w) = (c(w) + a) / (N + a (V + 1)), p(w | u) = (c(u w) + m p(w)) / (c(u) + m).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from boxoffice.functions.scale import materialize, shared_dir
from boxoffice.llm.batches import small_batches
from boxoffice.llm.elias_fano import EliasFano, pack_bits, unpack_bits
from boxoffice.llm.files import Reader, Writer, unique_name
from boxoffice.llm.textkit import Memo, fingerprints, first_of_each, per_text, slices, text_bytes, words

SLICE = 1 << 20
#: The fingerprint that stands for the end of a text; fingerprints of words are as random.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
WORDS_A_FILE, PAIRS_A_FILE = 1 << 18, 3 << 19
#: Pairs a counting task holds before it sends them on.
HELD = 4_000_000
#: log10 of probabilities in 12 bits, from -16 to 0.
BITS, LOWEST = 12, -16.0
STEP = -LOWEST / ((1 << BITS) - 1)


def quantise(log_p: np.ndarray) -> np.ndarray:
    return np.rint(np.maximum(log_p, LOWEST) / -STEP).astype(np.uint64)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the tokens of all texts, each closed by the end, and n + 1 offsets."""
    low, starts, ends, at = words(*text_bytes(column))
    prints = fingerprints(low, starts, ends)
    return np.insert(prints, at[1:], END), at + np.arange(len(at))


def distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def to_blob(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts: Elias-Fano, and a byte a count with the larger ones apart."""
    parts = EliasFano(keys).parts()
    large = counts[counts >= 255].astype(np.uint32)
    arrays = [*parts.values(), np.minimum(counts, 255).astype(np.uint8), large]
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    return sizes.tobytes() + b"".join(a.tobytes() for a in arrays)


def from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, 6)
    cut = np.cumsum(np.append(48, sizes))
    kinds = (np.uint64, np.uint64, np.uint8, np.uint32, np.uint8, np.uint32)
    head, low, bits, before, small, large = (np.frombuffer(blob[a:b], k) for a, b, k in zip(cut, cut[1:], kinds, strict=False))
    counts = small.astype(np.int64)
    counts[small == 255] = large
    return EliasFano.of({"head": head, "low": low, "bits": bits, "before": before}).all(), counts


@dataclass(frozen=True)
class Files:
    """What a task needs to open a model: paths in order, first word of each, and the totals."""

    words: tuple[tuple[str, int], ...]
    pairs: tuple[tuple[str, int], ...]
    tokens: int
    vocabulary: int
    add: float
    mass: float


class Trie:
    """Lookups for whole arrays. ``pairs`` may still be missing."""

    def __init__(self, files: Files):
        self.files = files
        readers = [Reader(path) for path, _ in files.words]
        self.lexicon = [(EliasFano.of(r.parts("words")), EliasFano.of(r.parts("counts"))) for r in readers]
        self.first_word = np.array([first for _, first in files.words], np.int64)
        self.first_print = np.array([r.meta["first_print"] for r in readers], np.uint64)
        self.successors = []
        for path, _ in files.pairs:
            r = Reader(path)
            self.successors.append((EliasFano.of(r.parts("pointers")), EliasFano.of(r.parts("followers")), r.get("codes")))
        self.first_context = np.array([first for _, first in files.pairs], np.int64)
        self.unigram_floor = files.tokens + files.add * (files.vocabulary + 1)
        self._forget()

    def _forget(self) -> None:
        self.known = Memo()
        self.number, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of distinct ascending fingerprints."""
        number, count = np.full(len(prints), -1, np.int64), np.zeros(len(prints), np.int64)
        cuts = np.append(np.searchsorted(prints, self.first_print), len(prints))
        for (names, totals), first, low, high in zip(self.lexicon, self.first_word, cuts, cuts[1:], strict=False):
            if low == high:
                continue
            place = names.find(prints[low:high])
            there = np.flatnonzero(place >= 0)
            found = place[there]
            number[low + there] = first + found
            count[low + there] = (totals.get(found + 1) - totals.get(found)).astype(np.int64)
        return number, count

    def words(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of words; those met are kept, up to a bound."""
        if self.known.size > 500_000:
            self._forget()
        at = self.known.find(prints)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, _ = first_of_each(prints[missing])
            size = self.known.size
            while size + len(new) > len(self.number):
                self.number, self.count = np.resize(self.number, 2 * len(self.number)), np.resize(self.count, 2 * len(self.count))
            self.number[size : size + len(new)], self.count[size : size + len(new)] = self._search(new)
            self.known.add(new, np.arange(size, size + len(new)))
            at[missing] = self.known.find(prints[missing])
        return self.number[at], self.count[at]

    def log_unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + self.files.add) / self.unigram_floor)

    def log_given(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p(word | context) of the pairs in the trie; NaN for others. Contexts ascend."""
        out = np.full(len(context), np.nan)
        cuts = np.append(np.searchsorted(context, self.first_context), len(context))
        for (pointers, followers, codes), first, low, high in zip(self.successors, self.first_context, cuts, cuts[1:], strict=False):
            own = context[low:high] - first
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
            bounds = pointers.get(np.append(own[head], own[head] + 1)).astype(np.int64)
            start, stop = bounds[: len(head)], bounds[len(head) :]
            # Numbers are counted on from the last successor of the contexts before.
            base = np.where(start > 0, followers.get(np.maximum(start - 1, 0)).astype(np.int64) + 1, 0) if followers.n else start
            repeat = np.diff(np.append(head, len(own)))
            goal = np.repeat(base, repeat) + word[low:high]
            place = followers.find(goal)
            inside = np.flatnonzero((place >= 0) & (place < np.repeat(stop, repeat)))
            out[low + inside] = unpack_bits(codes, BITS, place[inside]).astype(float) * -STEP
        return out


_open: dict[Files, Trie] = {}


def opened(files: Files) -> Trie:
    """One model per Python worker: the last that was asked for."""
    if files not in _open:
        _open.clear()
        _open[files] = Trie(files)
    return _open[files]


def _write_words(folder: str):
    def write(table: pa.Table) -> pa.Table:
        prints = table["print"].combine_chunks().to_numpy().view(np.uint64)
        order = np.argsort(prints)
        counts = table["count"].combine_chunks().to_numpy()[order]
        out = Writer(unique_name(folder, "words"))
        out.add_parts("words", EliasFano(prints[order]).parts())
        out.add_parts("counts", EliasFano(np.append(0, np.cumsum(counts))).parts())
        out.close(first_print=int(prints[order[0]]))
        return pa.table({"file": table["file"].slice(0, 1), "path": pa.array([out.path]), "n": pa.array([len(prints)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    return write


def build_words(texts: DataFrame, folder: str, add: float, mass: float) -> Files:
    """Count the words of ``text`` (null: empty) and write level 1. Words are dealt to files by the
    upper bits of their fingerprints, so files are even."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text", SLICE):
            held.append(distinct(tokens_of(part.column(0))[0]))
            size += len(held[-1][0])
            if size > HELD // 4:
                held = [distinct(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                size = len(held[0][0])
                if size > HELD // 4:
                    yield from _rows(*held[0])
                    held, size = [], 0
        if held:
            yield from _rows(*distinct(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))

    def _rows(prints: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(prints), 50_000):
            yield pa.record_batch([pa.array(prints[at : at + 50_000].view(np.int64)), pa.array(counts[at : at + 50_000])], names=["print", "count"])

    counted = texts.mapInArrow(count, "print long, count long").groupBy("print").agg(F.sum("count").alias("count"))
    with small_batches(texts.sparkSession):
        counted = materialize(counted, "word-counts")
    total = counted.agg(F.sum("count"), F.count(F.lit(1))).first()
    tokens, vocabulary = total[0] or 0, total[1]
    if vocabulary >= 1 << 32:
        raise ValueError("numbers of words have 32 bits")
    bits = max(0, (vocabulary // WORDS_A_FILE).bit_length())
    dealt = counted.withColumn("file", F.shiftrightunsigned("print", 64 - bits) if bits else F.lit(0).cast("long"))
    made = dealt.groupBy("file").applyInArrow(_write_words(folder), "file long, path string, n long, tokens long")
    rows = sorted(materialize(made, "word-files").collect(), key=lambda r: r["file"])
    first, paths = 0, []
    for row in rows:
        paths.append((row["path"], first))
        first += row["n"]
    return Files(tuple(paths), (), tokens, vocabulary, add, mass)


def _write_pairs(folder: str, files: Files, per_file: int):
    def write(table: pa.Table) -> pa.Table:
        number = table["file"][0].as_py()
        first = number * per_file
        some = [from_blob(b.as_py()) for b in table["blob"]]
        keys, counts = distinct(np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some]))
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        trie = opened(files)
        total = lambda numbers: _counts(trie, numbers)
        unique, inverse = np.unique(word, return_inverse=True)
        lower = 10 ** trie.log_unigram(total(unique))[inverse]
        contexts, own = np.unique(context, return_inverse=True)
        seen = total(contexts + first)[own]
        codes = quantise(np.log10((counts + files.mass * lower) / (seen + files.mass)))
        size = min(per_file, files.vocabulary - first)
        pointers = np.searchsorted(context, np.arange(size + 1))
        head = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        last = np.append(head[1:], len(context)) - 1
        base = np.append(0, np.cumsum(word[last] + 1)[:-1])
        followers = word + np.repeat(base, np.diff(np.append(head, len(context))))
        out = Writer(unique_name(folder, "pairs"))
        out.add_parts("pointers", EliasFano(pointers).parts())
        out.add_parts("followers", EliasFano(followers).parts())
        out.add("codes", pack_bits(codes, BITS))
        out.close()
        return pa.table({"file": pa.array([number], pa.int64()), "path": pa.array([out.path]), "n": pa.array([len(keys)], pa.int64())})

    return write


def _counts(trie: Trie, numbers: np.ndarray) -> np.ndarray:
    """Counts of ascending word numbers."""
    out = np.zeros(len(numbers), np.int64)
    cuts = np.append(np.searchsorted(numbers, trie.first_word), len(numbers))
    for (_, totals), first, low, high in zip(trie.lexicon, trie.first_word, cuts, cuts[1:], strict=False):
        own = numbers[low:high] - first
        out[low:high] = (totals.get(own + 1) - totals.get(own)).astype(np.int64)
    return out


def build_pairs(texts: DataFrame, folder: str, files: Files) -> Files:
    """Count pairs of neighbours and write level 2. A task sends the pairs of each file as one compact
    blob; a file holds the successors of a range of words. Words' numbers are as random as their
    fingerprints, so ranges are even but for single frequent contexts, which have at most as many
    successors as there are words."""
    if not files.vocabulary:
        return files
    number = max(1, -(-files.tokens // PAIRS_A_FILE))
    per_file = -(-files.vocabulary // number)

    def send(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        file = (keys >> np.uint64(32)).astype(np.int64) // per_file
        head = np.flatnonzero(np.append(True, file[1:] != file[:-1]))
        for low, high in zip(head, np.append(head[1:], len(keys)), strict=True):
            base = np.uint64(int(file[low]) * per_file) << np.uint64(32)
            blob = to_blob(keys[low:high] - base, counts[low:high])
            yield pa.record_batch([pa.array([int(file[low])], pa.int64()), pa.array([blob], pa.binary())], names=["file", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text", SLICE):
            prints, at = tokens_of(part.column(0))
            numbers = opened(files).words(prints)[0].astype(np.uint64)
            pairs = (numbers[:-1] << np.uint64(32)) | numbers[1:]
            held.append(distinct(np.delete(pairs, at[1:-1] - 1)))
            size += len(held[-1][0])
            if size > HELD:
                held = [distinct(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                size = len(held[0][0])
                if size > HELD * 3 // 4:
                    yield from send(*held[0])
                    held, size = [], 0
        if size:
            yield from send(*distinct(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))

    blobs = texts.mapInArrow(count, "file long, blob binary")
    made = blobs.groupBy("file").applyInArrow(_write_pairs(folder, files, per_file), "file long, path string, n long")
    with small_batches(texts.sparkSession):
        rows = materialize(made, "pair-files").collect()
    pairs = tuple((r["path"], r["file"] * per_file) for r in sorted(rows, key=lambda r: r["file"]))
    return Files(files.words, pairs, files.tokens, files.vocabulary, files.add, files.mass)


def score_texts(rows: DataFrame, files: Files) -> DataFrame:
    """Add n_tokens, n_known, base_score and score to rows with ``text``, which is dropped."""
    kept = [c for c in rows.columns if c != "text"]
    more = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
    schema = rows.drop("text").withColumns({name: F.lit(0).cast(kind) for name, kind in more.items()}).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            trie = opened(files)
            prints, at = tokens_of(part.column(part.schema.get_field_index("text")))
            number, count = trie.words(prints)
            base = trie.log_unigram(count)
            log_p = base.copy()
            follows = np.ones(len(prints), bool)
            follows[at[:-1][at[:-1] < len(prints)]] = False
            place = np.flatnonzero(follows)
            place = place[number[place - 1] >= 0]
            context, word = number[place - 1], number[place]
            # Unknown words, and pairs that are not in the trie, get the context's share for the unseen.
            found = np.full(len(place), np.nan)
            known = np.flatnonzero(word >= 0)
            keys, inverse = np.unique(context[known] << 32 | word[known], return_inverse=True)
            found[known] = trie.log_given(keys >> 32, keys & 0xFFFFFFFF)[inverse]
            unseen = np.log10(files.mass / (count[place - 1] + files.mass)) + base[place]
            log_p[place] = np.where(np.isnan(found), unseen, found)
            owner = np.repeat(np.arange(part.num_rows), np.diff(at))
            sums = [np.bincount(owner, weights=v, minlength=part.num_rows) for v in (base, log_p)]
            values = [np.diff(at), per_text((count > 0).astype(np.int64), at), *sums]
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.record_batch([*columns, *map(pa.array, values)], names=[*kept, *more])

    return rows.mapInArrow(score, schema)


def held_out(id_col: str) -> Column:
    """Documents that are not learnt from: crc32 of the id as text ends in 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def language_model_scores(docs: DataFrame, add: float = 0.1, mass: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from all rows that are not held out; a null id is not. A null or empty text is the end
    alone. ``base_score`` is the unigram score with ``add`` for each word; ``score`` the model's.
    Without training rows every token is unknown. Words are told apart by 64-bit fingerprints. The
    model lies in files in the shared folder; a task maps them and holds the words it has met, up to a
    bound. Rows that repeat are learnt from, and scored, each on its own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    folder = unique_name(shared_dir(docs.sparkSession), "trie")
    texts = rows.filter(~F.col("held_out")).select("text")
    files = build_pairs(texts, folder, build_words(texts, folder, add, mass))
    scored = score_texts(rows, files).withColumn("train_tokens", F.lit(files.tokens).cast("long"))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
