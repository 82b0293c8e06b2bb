"""Benchmark decontamination: passages of documents within a small edit distance of benchmark items.

A random walk over words (the CGK embedding) writes the word it stands on in every step and moves on
by a random bit that depends on the step and the word. Two sequences at a small edit distance give
walks at a small Hamming distance, as walks that fall out of step meet again. Bit sampling hashes the
words of a few steps into a key; ``repeats`` walks with other bits reach the recall that is asked for.
Walks start at every word of every document and at every word of each item: a key in common names an
item-sized window, which is verified by its exact edit distance. Short items leave walks less room, so
the sampled steps lie closer together for them; the steps grow with the item in a few classes of sizes.

Items of every size have further keys of their own: they are cut into one piece more than the edits they
allow, an edit changes one piece at most, so a passage within the edits holds a piece unchanged
(pigeonhole), and the pieces' words are keys as well. So no passage within the edits is missed by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boxoffice.functions.scale import materialize
from boxoffice.llm.batches import small_batches
from boxoffice.llm.textkit import Memo, fingerprints, mix, slices, text_bytes, words

#: Steps whose words are hashed, by the least number of words of an item.
SAMPLED = ((25, (0, 4, 8, 12)), (13, (0, 3, 6)), (5, (0, 2, 4)), (2, (0, 1)), (1, (0,)))
#: Items are taken in blocks of about this many bytes of text; a block is broadcast.
BLOCK_BYTES = 8 << 20
CHECKED = 256
#: Places of keys that are expanded at once, and windows that wait until they are verified.
EXPANDED = 1 << 20


def _codes(h: np.ndarray, repeat: int) -> np.ndarray:
    return mix(h ^ np.uint64(0x5851F42D4C957F2D * (repeat + 1) % (1 << 64)))


def walk_keys(h: np.ndarray, repeat: int, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For a walk from each word: the key of its sampled steps and the place it has reached. ``h`` must
    have as many spare words at its end as there are steps."""
    n = len(h) - steps[-1]
    codes, at = _codes(h, repeat), np.arange(n)
    key = np.full(n, np.uint64((repeat * 64 + steps[-1]) * 64 + len(steps)))
    for step in range(steps[-1] + 1):
        here = codes[at]
        if step in steps:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + here)
        if step < steps[-1]:
            at += ((here >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
    return key, at


def run_keys(h: np.ndarray, width: int) -> np.ndarray:
    """The key of the ``width`` words from each word. ``h`` must have width - 1 spare words at its end."""
    n = len(h) - width + 1
    key = np.full(n, np.uint64((1 << 32) + width))
    for k in range(width):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return key


def pieces(size: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first word and length of the pieces of items of ``size`` words, one more than their edits
    (at most one a word); the pieces of an item do not overlap and have one length."""
    number = np.minimum(edits + 1, size)
    owner = np.repeat(np.arange(len(size)), number)
    k = np.arange(len(owner)) - (np.cumsum(number) - number)[owner]
    return owner, k * size[owner] // number[owner], size[owner] // number[owner]


@dataclass
class Items:
    """The items of one block: their words, and where their walks and pieces begin by key."""

    ids: np.ndarray
    h: np.ndarray
    at: np.ndarray
    edits: np.ndarray
    walks: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    widths: list[int] = field(default_factory=list)
    memo: Memo = field(default_factory=Memo)
    cut: np.ndarray | None = None
    anchor_item: np.ndarray | None = None
    anchor_place: np.ndarray | None = None


def index_items(ids: list[int | None], texts: pa.Array, share: float, repeats: int) -> Items:
    low, starts, ends, at = words(*text_bytes(texts))
    h = fingerprints(low, starts, ends)
    size = np.diff(at)
    items = Items(np.array([-1 if i is None else i for i in ids], np.int64), h, at, np.floor(size * share + 1e-9).astype(np.int64))
    keys, owners, places = [], [], []
    owner = np.repeat(np.arange(len(size)), size)
    top = 1 << 62
    for least, steps in SAMPLED:
        mine = (size >= least) & (size < top)
        top = least
        if not mine.any():
            continue
        padded = np.append(h, np.zeros(steps[-1], np.uint64))
        for repeat in range(repeats):
            key, reached = walk_keys(padded, repeat, steps)
            # A walk must end within its item.
            ok = np.flatnonzero(mine[owner] & (reached < at[owner + 1]))
            keys.append(key[ok])
            owners.append(owner[ok])
            places.append(ok - at[owner[ok]])
            items.walks.append((repeat, steps))
    some = np.flatnonzero(size > 0)
    own, first, width = pieces(size[some], items.edits[some])
    items.widths = np.unique(width).tolist()
    for w in items.widths:
        mine = np.flatnonzero(width == w)
        key = run_keys(np.append(h, np.zeros(w - 1, np.uint64)), w)
        owners.append(some[own[mine]])
        places.append(first[mine])
        keys.append(key[at[owners[-1]] + first[mine]])
    if keys:
        key, own, place = map(np.concatenate, (keys, owners, places))
        order = np.lexsort((place, own, key))
        key, items.anchor_item, items.anchor_place = key[order], own[order], place[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        items.cut = np.append(head, len(key))
        key = key[head]
        key[key == 0] = 1
        items.memo.add(key, np.arange(len(head)))
    return items


def best_end(items: np.ndarray, sizes: np.ndarray, windows: np.ndarray, free: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least edit distance of the item to a passage of the window, and the passage's
    end; the first of equals. ``free``: it may begin anywhere, else at the window's front. Items are
    padded at the end; window words of 0 match nothing."""
    rows, width = windows.shape
    place = np.arange(width + 1)
    cost = np.zeros((rows, width + 1), np.int32) if free else np.tile(place.astype(np.int32), (rows, 1))
    final = np.where((sizes == 0)[:, None], cost, 0)
    for i in range(items.shape[1]):
        new = np.empty_like(cost)
        new[:, 0] = i + 1
        differs = (windows != items[:, i : i + 1]) | (windows == 0)
        new[:, 1:] = np.minimum(cost[:, :-1] + differs, cost[:, 1:] + 1)
        # Words of the window that are left out: a running minimum along the row.
        cost = (np.minimum.accumulate(new - place, axis=1) + place).astype(np.int32)
        done = sizes == i + 1
        final[done] = cost[done]
    end = final.argmin(axis=1)
    return final[np.arange(rows), end], end


def _rectangle(h: np.ndarray, start: np.ndarray, size: np.ndarray, back: bool = False) -> np.ndarray:
    """Rows of words from ``start``, padded by 0; ``back``: each reversed."""
    width = int(size.max()) if len(size) else 0
    place = np.arange(width)
    inside = place < size[:, None]
    at = start[:, None] + (size[:, None] - 1 - place if back else place)
    return np.where(inside, h[np.clip(at, 0, max(len(h) - 1, 0))], 0)


def _places(items: Items, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Item, place in ``h`` and place in the item of keys in common, a bounded number at a time."""
    total = len(h)
    steps = max([steps[-1] for _, steps in items.walks], default=0)
    padded = np.append(h, np.zeros(max([steps, *items.widths]), np.uint64))
    walks = (walk_keys(padded[: total + steps[-1]], repeat, steps)[0] for repeat, steps in items.walks)
    for key in chain(walks, (run_keys(padded[: total + w - 1], w) for w in items.widths)):
        key[key == 0] = 1
        hit = items.memo.find(key)
        start = np.flatnonzero(hit >= 0)
        group = hit[start]
        number = items.cut[group + 1] - items.cut[group]
        upto = np.cumsum(number)
        low = 0
        while low < len(start):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + EXPANDED, "right")))
            own, first = number[low:high], items.cut[group[low:high]]
            anchor = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            yield items.anchor_item[anchor], np.repeat(start[low:high], own), items.anchor_place[anchor]
            low = high


def _windows(items: Items, h: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (document, item, bucket) of windows to verify, those that met by several keys once."""
    held, count = [np.zeros((0, 3), np.int64)], 0
    for item, place, anchor in _places(items, h):
        doc = np.searchsorted(at, place, "right") - 1
        # Windows whose starts are within the edits of each other are verified as one.
        bucket = (place - anchor - at[doc]) // (items.edits[item] + 1)
        held.append(np.unique(np.stack([doc, item, bucket], 1), axis=0))
        count += len(held[-1])
        if count > EXPANDED:
            held = [np.unique(np.concatenate(held), axis=0)]
            count = len(held[0])
            if 2 * count > EXPANDED:
                yield held[0]
                held, count = [held[0][:0]], 0
    yield np.unique(np.concatenate(held), axis=0)


def _verified(items: Items, h: np.ndarray, at: np.ndarray, windows: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The windows that hold a passage within the edits, and the best passage of each."""
    doc, item, bucket = windows.T
    edits, size = items.edits[item], np.diff(items.at)[item]
    low = np.maximum(bucket * (edits + 1) - edits, 0) + at[doc]
    high = np.minimum(at[doc] + (bucket + 1) * (edits + 1) + 2 * edits + size, at[doc + 1])
    order = np.argsort(size, kind="stable")
    rows = []
    for block in range(0, len(order), CHECKED):
        o = order[block : block + CHECKED]
        length = np.maximum(high[o] - low[o], 0)
        own = _rectangle(items.h, items.at[item[o]], size[o])
        cost, end = best_end(own, size[o], _rectangle(h, low[o], length), True)
        good = np.flatnonzero(cost <= edits[o])
        if not len(good):
            continue
        o, cost, end = o[good], cost[good], end[good]
        # Backwards from the end, the best passage that ends there.
        back = _rectangle(items.h, items.at[item[o]], size[o], True)
        _, span = best_end(back, size[o], _rectangle(h, low[o], end, True), False)
        rows.append((doc[o], item[o], cost, low[o] + end - span - at[doc[o]], span))
    return rows


def find_in(items: Items, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches in documents of words ``h`` with n + 1 offsets ``at``: document, item, edits, start
    (word of the document) and length; the best of each pair."""
    rows, none = [], np.zeros(0, np.int64)
    for windows in _windows(items, h, at):
        rows += _verified(items, h, at, windows)
    if not rows:
        return none, none, none, none, none
    doc, item, cost, start, span = (np.concatenate([r[k] for r in rows]).astype(np.int64) for k in range(5))
    order = np.lexsort((span, start, cost, item, doc))
    doc, item, cost, start, span = (x[order] for x in (doc, item, cost, start, span))
    best = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))
    return doc[best], item[best], cost[best], start[best], span[best]


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per pair of a row of docs and an item it holds: ``id_col``, ``item_col``, edits (words inserted,
    left out or changed, at most the ``share`` of the item's words, rounded down), item_words,
    start_word and n_words of the passage with the fewest edits, the first of equals.

    A-Z are folded; words are runs without white space. Null or empty texts and items hold and match
    nothing. Repeated items or rows each give their pairs; null ids stay. ``share`` is below 1. Every
    passage within the edits is found, by walks or by pieces. Items are broadcast in blocks
    of about ``block_bytes``, and each block reads the documents once. A task holds about 300 bytes per word of
    a slice of half a MB, or of one longer text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = "id long, item long, edits long, item_words long, start_word long, n_words long"
    out = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").toArrow()
        index = index_items(part["item"].to_pylist(), part["text"], share, repeats)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for piece in slices(batches, "text"):
                low, starts, ends, at = words(*text_bytes(piece.column(1)))
                doc, item, edits, start, span = find_in(own, fingerprints(low, starts, ends), at)
                if len(doc):
                    names = pa.array(own.ids[item], mask=own.ids[item] == -1)
                    sizes = np.diff(own.at)[item]
                    yield pa.record_batch([piece.column(0).take(pa.array(doc)), names, *map(pa.array, (edits, sizes, start, span))], names=["id", "item", "edits", "item_words", "start_word", "n_words"])

        found = rows.mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    with small_batches(docs.sparkSession):
        out = materialize(out, "contaminated")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", "item_words", "start_word", "n_words")
