"""An exact Jaccard join of documents' shingle sets through parity sketches.

Sets of similar size share a band. A band's sketch has so many blocks that one symmetric difference the
band can still allow leaves some of them unchanged: a token flips the parity of its own place in one
block, and a block is kept as the XOR of its odd tokens' 64-bit codes, so the number of blocks in which
two sketches differ is at most the size of the symmetric difference. Sets that may be similar hence
agree in a block, and in ``spare`` more than one; documents meet in the buckets of equal blocks.

Not all pairs of a bucket are made. Equal sets are one class from the start. In each bucket one class is
compared with the others, and then one of those that are not in its component; only buckets whose members are
then still in different components are looked at again. Small ones are, pair by pair. Members of large ones
share much that is common, as passages that many documents quote; they meet again by their rarest
shingles, of which similar sets share one among so few that the rest would not do (prefix filter). What
is large even then is compared in blocks of a task's size. Blocks meet in rounds, each with its own and then with those at growing
distances; only members of different components are compared, a pair of blocks returns a spanning forest
of the components it joins, and components are contracted after each round. So the links that are
written grow with a family's members and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from boxoffice.functions.scale import discard, materialize, settled
from boxoffice.llm.batches import small_batches
from boxoffice.llm.components import connected_components
from boxoffice.llm.shingles import overlaps, shingle_sets
from boxoffice.llm.textkit import mix, slices, text_bytes

#: A bucket of more classes is large: its key is given up by classes with few of them.
LARGE = 32
#: Shingles in one side of a block comparison.
BLOCK_SHINGLES = 40_000
#: A member counts as at least so many shingles, so that a block of short sets has few members too.
LEAST_WEIGHT = 24
#: Members of a pair of blocks that are compared with all others at once.
STRIP_ROWS = 512
#: Classes of a bucket that are compared with all its others before pairs are made.
STARS = 2
GROWTH = 1.5
#: Fingerprints of sets a task remembers.
MET = 200_000
#: Cells in which shingles are counted, up to MOST each, and ranges of cells that are summed up apart.
CELLS, RANGES, MOST = 1 << 24, 64, 255
#: Keys have 48 bits: false meetings are few and cost a test; shuffled rows are smaller.
KEY_BITS = 48


class Bands:
    """Bands of set sizes for a similarity of at least ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
        self.edges = np.array(edges, np.int64)
        top = self.edges[1:] - 1
        # |A - B| + |B - A| = |A| + |B| - 2 |A & B|, and |A & B| >= p / (100 + p) (|A| + |B|).
        self.most = 2 * top * (100 - percent) // (100 + percent)
        # Spare blocks for those with at most ``thin_tokens`` tokens, whose number is about Poisson, at
        # the least set size that meets the band, and for those whose buckets are large.
        self.thin_tokens = 1 if percent >= 88 else 0
        self.heavy = 2 + self.most // (20 if percent >= 88 else 10)
        rate = percent * self.edges[:-1] / 100 / (1.15 * self.most + 3 + self.heavy)
        thin = (self.most + 1) * np.exp(-rate) * (1 + rate * self.thin_tokens)
        self.thin = np.ceil(thin + 3 * np.sqrt(thin)).astype(np.int64) + 1
        self.blocks = self.most + 1 + self.thin + self.heavy
        # Where no difference is allowed, equal sets are classes already.
        self.idle = self.most == 0

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1

    def reaches_next(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a set may be similar to a larger one of the next band."""
        return 100 * sizes >= self.percent * self.edges[band + 1]


@lru_cache(maxsize=4)
def bands(percent: int) -> Bands:
    return Bands(percent)


def sketch_keys(h: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of each set (shingles ascending, n + 1 offsets), and their n + 1 offsets."""
    b = bands(percent)
    sizes = np.diff(at)
    n = len(sizes)
    own = b.of(np.maximum(sizes, 1))
    parts = []
    for step in (0, 1):
        band = own + step
        used = (sizes > 0) & ~b.idle[band]
        if step:
            used &= b.reaches_next(sizes, own)
        blocks = np.where(used, b.blocks[band], 0)
        first = np.cumsum(blocks) - blocks
        owner = np.repeat(np.arange(n), sizes)
        keep = used[owner]
        owner, codes = owner[keep], h[keep]
        # Shingles are dealt to blocks by their upper bits, so ascending shingles are in block order.
        block = ((codes >> np.uint64(32)) * blocks[owner].astype(np.uint64)) >> np.uint64(32)
        flat = first[owner] + block.astype(np.int64)
        total = int(blocks.sum())
        count = np.bincount(flat, minlength=total)
        value = np.zeros(total, np.uint64)
        if len(flat):
            begin = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            value[flat[begin]] = np.bitwise_xor.reduceat(mix(codes), begin)
        holder = np.repeat(np.arange(n), blocks)
        place = np.arange(total) - first[holder]
        # Thin blocks say little; they are left out where the spare blocks allow it.
        thin = count <= b.thin_tokens
        few = np.bincount(holder, weights=thin, minlength=n) <= b.thin[band]
        emit = ~(thin & few[holder])
        key = mix(value + mix((band[holder] * np.int64(1 << 32) + place).astype(np.uint64))) >> np.uint64(64 - KEY_BITS)
        parts.append((holder[emit], key[emit]))
    holder, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(holder, kind="stable")
    return key[order], np.searchsorted(holder[order], np.arange(n + 1))


def _prints_of(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A 128-bit fingerprint of each set, as two numbers."""
    sums = [np.append(np.uint64(0), np.cumsum(mix(h ^ np.uint64(seed)), dtype=np.uint64)) for seed in (0x51ED270B, 0xA3B195354A39B70D)]
    return [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]


def set_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """id, real, n (set size), s1 and s2 (the set's fingerprint) of rows (id, text, real)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            h, at = shingle_sets(part.column(1), shingle)
            prints = _prints_of(h, at)
            yield pa.record_batch([part.column(0), part.column(2), pa.array(np.diff(at)), *map(pa.array, prints)], names=["id", "real", "n", "s1", "s2"])

    return docs.select("id", "text", "real").mapInArrow(make, "id long, real long, n long, s1 long, s2 long")


def bucket_keys(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """id and key, a row for each block of the sketches of ``text``. A task leaves out sets that it has
    just met: an equal one stands for them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for part in slices(batches, "text"):
            h, at = shingle_sets(part.column(1), shingle)
            new = np.zeros(part.num_rows, bool)
            ids = part.column(0)
            for k, own in enumerate(zip(*(p.tolist() for p in _prints_of(h, at)), strict=True)):
                if own not in met:
                    met.add(own)
                    new[k] = True
            if len(met) > MET:
                met.clear()
            sizes = np.diff(at)
            keep = np.repeat(new, sizes)
            keys, cut = sketch_keys(h[keep], np.append(0, np.cumsum(sizes[new])), percent)
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.record_batch([ids.filter(pa.array(new)), lists], names=["id", "keys"])

    return docs.select("id", "text").mapInArrow(make, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _by_band(size: Column, values: np.ndarray, percent: int) -> Column:
    """The value of the band of a set size."""
    b, out = bands(percent), F.lit(0)
    for k in range(int(b.of(np.array([1 << 31]))[0]), -1, -1):
        out = F.when(size < int(b.edges[k + 1]), int(values[k])).otherwise(out)
    return out


def _blocks_in_common(a: Column, b: Column, percent: int) -> Column:
    """So many kept blocks at least are equal in the sketches of similar sets of these sizes: all but
    one for each token they may differ by, the thin ones and the spare large ones."""
    differ = F.floor((a + b) * (100 - percent) / (100 + percent))
    return _by_band(F.greatest(a, b), bands(percent).most, percent) + 1 - differ


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by whole intersections."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(np.diff(text_bytes(batch.column(k))[1]) for k in (2, 3))
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) >> 19, prepend=-1)) if batch.num_rows else []
            for at, to in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(at, to - at)
                left, right = (shingle_sets(part.column(k), shingle) for k in (2, 3))
                both = overlaps(*left, *right)
                union = np.diff(left[1]) + np.diff(right[1]) - both
                hit = pa.array((100 * both >= percent * union) & (union > 0))
                yield pa.record_batch([part.column(0).filter(hit), part.column(1).filter(hit)], names=["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(test, "a long, b long")


class _Labels:
    """Components of a pair of blocks: the label of each member, and the links that joined labels."""

    def __init__(self, labels: np.ndarray):
        self.names, self.of = np.unique(labels, return_inverse=True)
        self.links: list[tuple[int, int]] = []

    def join(self, row: int, others: np.ndarray) -> None:
        """A member is linked with others."""
        own = self.of[row]
        met = np.unique(self.of[others])
        met = met[met != own]
        if len(met):
            self.links += [(own, x) for x in met.tolist()]
            turn = np.arange(len(self.names))
            turn[met] = own
            self.of = turn[self.of]


def _block_links(shingle: int, percent: int):
    """Compare the texts of a pair of blocks (or of one with itself) that are in different components;
    return links between components, as many as it takes to join them."""

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("own")
        block = table["own"].to_numpy()
        cut = int(np.searchsorted(block, block[-1])) if table.num_rows else 0
        labels = _Labels(table["label"].to_numpy())
        h, at = shingle_sets(table["text"].combine_chunks(), shingle)
        sizes, owner = np.diff(at), np.repeat(np.arange(table.num_rows), np.diff(at))
        tokens, column = np.unique(h, return_inverse=True)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        # Rows of the first block against those of the second, or of one block against its later rows.
        for top in range(0, cut or table.num_rows, STRIP_ROWS):
            to = min(top + STRIP_ROWS, cut or table.num_rows)
            low = cut or top
            if len(np.unique(labels.of)) == 1:
                break
            shared = np.zeros((to - top, table.num_rows - low), np.float32)
            for start in range(0, len(tokens), 2048):
                a, b = np.searchsorted(column, [start, start + 2048])
                matrix = np.zeros((table.num_rows, 2048), np.float32)
                matrix[owner[a:b], column[a:b] - start] = 1
                shared += matrix[top:to] @ matrix[low:].T
            union = sizes[top:to, None] + sizes[None, low:] - shared
            hit = (100 * shared >= percent * union) & (union > 0)
            for row in range(top, to):
                labels.join(row, low + np.flatnonzero(hit[row - top]))
        links = labels.names[np.array(labels.links, np.int64).reshape(-1, 2)]
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return link


def _family_links(rows: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between the components (label) of the members of large buckets (key, rep, n, lead, label).
    Families are what large buckets hold together; a family is cut into blocks, which meet in rounds."""
    spark = rows.sparkSession
    if rows.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    families = connected_components(rows.select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    members = families.join(rows.select(F.col("rep").alias("node"), "n", "label").distinct(), "node")
    weights = members.groupBy("component").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST_WEIGHT))) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = members.join(weights, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = materialize(placed.select(F.col("component").alias("family"), F.col("node").alias("id"), "block", "blocks", "label"), "families")
    most = placed.agg(F.max("blocks")).first()[0] or 0
    links, low, high = None, 0, 0
    while low < max(most, 1):
        apart = placed.groupBy("family").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter(F.col("x") < F.col("y")).select("family")
        live = placed.join(apart, "family", "left_semi")
        # Every block meets those ``low`` to ``high`` after it; a member goes to pairs on both sides.
        steps = F.explode(F.sequence(F.lit(low), F.lit(high)))
        after = live.withColumn("step", steps).withColumn("i", F.col("block")).withColumn("j", F.col("block") + F.col("step"))
        sides = [after] if not low else [after, live.withColumn("step", steps).withColumn("i", F.col("block") - F.col("step")).withColumn("j", F.col("block"))]
        spread = sides[0] if not low else sides[0].unionByName(sides[1])
        spread = spread.filter((F.col("i") >= 0) & (F.col("j") < F.col("blocks"))).select("family", "id", "label", F.col("block").alias("own"), "i", "j")
        spread = materialize(spread, "spread")
        open_ = spread.groupBy("family", "i", "j").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter(F.col("x") < F.col("y")).select("family", "i", "j")
        grouped = spread.join(open_, ["family", "i", "j"], "left_semi").join(texts.select("id", "text"), "id")
        found = grouped.groupBy("family", "i", "j").applyInArrow(_block_links(shingle, percent), "a long, b long")
        with small_batches(spark):
            found = materialize(found, "links")
        links = found if links is None else links.unionByName(found)
        low, high = (1, 1) if not low else (2 * low, 4 * low - 1)
        if low < most and not found.isEmpty():
            joined = connected_components(links)
            start = placed.select("family", "id", "block", "blocks", F.col("label").alias("was"))
            placed = materialize(start.join(joined, F.col("was") == F.col("node"), "left").select("family", "id", "block", "blocks", F.coalesce("component", "was").alias("label")), "families")
    return links


def _apart(buckets: DataFrame) -> DataFrame:
    """The buckets (key, label, ...) with members of more than one component."""
    apart = buckets.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") < F.col("high")).select("k")
    return buckets.join(apart, F.col("key") == F.col("k"), "left_semi")


def _shingle_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many sets of texts (rep, n, label, text) hold a shingle, ``MOST`` if more, by cells of shingles: all are
    counted, those of a cell as one. Tasks send the cells they have met, in lists for each range of cells."""
    span = CELLS // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(CELLS, np.uint8)
        for part in slices(batches, "text"):
            cells, times = np.unique(_cells(shingle_sets(part.column(3), shingle)[0]), return_counts=True)
            own[cells] = np.minimum(own[cells] + times, MOST)
        met = np.flatnonzero(own)
        cut = np.searchsorted(met, np.arange(RANGES + 1) * span).astype(np.int32)
        cells = pa.ListArray.from_arrays(pa.array(cut), pa.array((met % span).astype(np.int32)))
        times = pa.array([own[met[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        if len(met):
            yield pa.record_batch([pa.array(np.arange(RANGES, dtype=np.int32)), cells, times], names=["range", "cells", "times"])

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(span, np.uint8)
        for cells, times in zip(table["cells"], table["times"], strict=True):
            at = cells.values.to_numpy()
            sums[at] = np.minimum(sums[at].astype(np.int32) + np.frombuffer(times.as_py(), np.uint8), MOST)
        return pa.table({"range": table["range"][:1], "times": pa.array([sums.tobytes()], pa.binary())})

    sent = texts.mapInArrow(count, "range int, cells array<int>, times binary")
    counts = np.zeros(CELLS, np.uint8)
    # Written first, so that tasks sum up ranges at once and the driver holds few of them beside the table.
    sums = materialize(sent.groupBy("range").applyInArrow(add, "range int, times binary"), "counts")
    for row in sums.toLocalIterator():
        counts[row["range"] * span : (row["range"] + 1) * span] = np.frombuffer(row["times"], np.uint8)
    return counts


def _cells(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(CELLS)).astype(np.int64)


def rare_keys(members: DataFrame, texts: DataFrame, shingle: int, percent: int, least: int = 1) -> DataFrame:
    """members(rep, n, label) and their texts (id, text) to rows (key, rep, n, label): the rarest shingles of
    each set, where sets that are similar share one. Of n shingles all but n * percent / 100 may be missing
    in the other set; so many and one more are taken, in an order that all sets have in common. It is by
    the counts of cells of shingles, a table of fixed size, so that a task picks and sends these shingles alone.
    Shingles of one component alone meet nothing and are left out; those in cells that count fewer than ``least`` sets
    are taken, but not sent."""
    spark = members.sparkSession
    own = materialize(members.join(texts, F.col("rep") == F.col("id")).select("rep", "n", "label", "text"), "texts")
    counts = spark.sparkContext.broadcast(_shingle_counts(own, shingle))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            h, at = shingle_sets(part.column(3), shingle)
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            times = counts.value[_cells(h)]
            order = np.lexsort((h, times, owner))
            taken = np.minimum(size - -(-size * percent // 100) + 1, size)
            sent = (np.arange(len(h)) - at[owner] < taken[owner]) & (times[order] >= least)
            cut = np.append(0, np.cumsum(np.bincount(owner[sent], minlength=len(size))))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h[order][sent].view(np.int64)))
            yield pa.record_batch([*part.columns[:3], lists], names=["rep", "n", "label", "keys"])

    schema = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("rep", "n", "label"))
    rare = own.mapInArrow(make, f"{schema}, keys array<long>").select(F.explode("keys").alias("key"), "rep", "n", "label")
    rare = materialize(rare, "rare")
    counts.destroy()
    discard(spark, own)
    return _apart(rare)


def _star_pairs(buckets: DataFrame, percent: int, bound: bool = True) -> DataFrame:
    """Pairs (a, b) of one member of each bucket (key, rep, n, label), of the component with the largest
    label, and those of other components. The Hamming distance of sketches bounds the difference of sets:
    pairs that meet in too few buckets are not similar. Here this is only a choice of pairs to try first. Without ``bound`` the keys are not blocks."""
    head = F.max(F.struct("label", (-F.col("rep")).alias("rep"), "n")).alias("h")
    heads = materialize(buckets.groupBy(F.col("key").alias("k")).agg(head).select("k", F.col("h.label").alias("l_a"), (-F.col("h.rep")).alias("a"), F.col("h.n").alias("n_a")), "heads")
    pairs = buckets.join(heads, F.col("key") == F.col("k")).filter((F.col("label") != F.col("l_a")) & _similar_sizes(F.col("n"), F.col("n_a"), percent))
    met = pairs.groupBy("a", F.col("rep").alias("b"), "n_a", "n").agg(F.count(F.lit(1)).alias("met"))
    met = met.filter(F.col("met") >= _blocks_in_common(F.col("n_a"), F.col("n"), percent)) if bound else met
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _small_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of members of different components of buckets (key, rep, n, label) of bounded
    size, and in how many they met."""
    left = buckets.select("key", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("l_a"))
    right = buckets.select("key", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("l_b"))
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("l_a") != F.col("l_b")) & _similar_sizes(F.col("n_a"), F.col("n_b"), percent))
    return pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("met"))


def _family_pairs(members: DataFrame, texts: DataFrame, tested: DataFrame, links: DataFrame, shingle: int, percent: int, large: int) -> DataFrame:
    """Links among members(rep, n, label) of large buckets by their rarest shingles: as with blocks one
    member of a bucket is compared with the others first, then small buckets are pair by pair and large ones
    as families. ``links`` are those known so far, ``tested`` the pairs that need no further look."""
    spark = members.sparkSession
    # A shingle that one set alone holds meets nothing.
    rare = materialize(rare_keys(members, texts, shingle, percent, least=2), "rare")
    stars = materialize(_star_pairs(rare, percent, bound=False).join(tested, ["a", "b"], "left_anti"), "stars")
    with small_batches(spark):
        more = materialize(verify(stars, texts, shingle, percent), "links")
    joined = materialize(connected_components(links.unionByName(more)), "components")
    rare = rare.drop("label").join(joined, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep"))
    rare = materialize(_apart(materialize(rare.select("key", "rep", "n", "label"), "rare")), "rare")
    sizes = rare.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("lead"))
    sized = materialize(rare.join(sizes, F.col("key") == F.col("k")).select("key", "rep", "n", "lead", "label", (F.col("members") > large).alias("large")), "rare")
    last = _small_pairs(sized.filter(~F.col("large")), percent).select("a", "b")
    last = materialize(last.join(tested.unionByName(stars), ["a", "b"], "left_anti"), "pairs")
    with small_batches(spark):
        more = more.unionByName(materialize(verify(last, texts, shingle, percent), "links"))
    return more.unionByName(_family_links(sized.filter("large"), texts, shingle, percent))


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """Per row: ``id_col``, n_shingles and component_id, the least id reachable by links.

    A-Z are folded; words are runs without white space; the sets hold distinct ``shingle``-word
    sequences, of shorter texts the whole sequence. Two rows link if 100 * shared >= ``percent`` * union.
    Null and empty texts have no shingles and link with nothing: their component is their own id. Rows
    without an id link like others; they have their component's least id, null if no row of it has one.
    Rows that repeat an id stand for the same node. Sets are compared by 64-bit fingerprints of
    shingles, rows without an id are told apart by one of their text.
    """
    spark = docs.sparkSession
    return settled(spark, lambda: _components(docs, shingle, percent, id_col, text_col, large), "groups")


def _components(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, large: int) -> DataFrame:
    spark = docs.sparkSession
    own, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.select(F.coalesce(own, F.xxhash64(text)).alias("id"), text.alias("text"), own.alias("real"))
    with small_batches(spark):
        sets = materialize(set_prints(rows, shingle), "sets")
    found = sets.filter(F.col("n") > 0).groupBy("n", "s1", "s2").agg(F.min("real").alias("real"), F.min("id").alias("any"))
    classes = materialize(found.select("n", "s1", "s2", "real", F.coalesce("real", "any").alias("rep")), "classes")
    # Keys are made twice: for the counts, which combine before the shuffle, and for the join with the
    # keys that are met more than once. Ids then give way to their classes' representatives.
    heads = classes.select(F.col("rep").alias("own"), "n")
    keyed = bucket_keys(rows, shingle, percent)
    buckets = keyed.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1).select("k")
    with small_batches(spark):
        raw = materialize(keyed.join(buckets, F.col("key") == F.col("k"), "left_semi").select("key", "id"), "buckets")
    named = sets.join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select(F.col("id").alias("own_id"), "rep").distinct()
    met = materialize(raw.join(named, F.col("id") == F.col("own_id")).select("key", "rep").distinct(), "buckets")
    discard(spark, raw)
    sizes = met.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("lead")).filter(F.col("members") > 1)
    wide = materialize(met.join(sizes, F.col("key") == F.col("k")).select("key", "rep", "members", "lead"), "buckets")
    discard(spark, met)
    # A class with few large buckets has enough small ones.
    heavy = F.col("members") > large
    loads = materialize(wide.filter(heavy).groupBy(F.col("rep").alias("r")).agg(F.count(F.lit(1)).alias("load")), "loads")
    sized = heads.join(loads, F.col("own") == F.col("r"), "left").select("own", "n", F.coalesce("load", F.lit(0)).alias("load"))
    kept = wide.join(sized, F.col("rep") == F.col("own")).filter(~heavy | (F.col("load") > _by_band(F.col("n"), bands(percent).heavy, percent)))
    open_ = materialize(kept.select("key", "rep", "n", "lead", heavy.alias("large"), F.col("rep").alias("label")), "buckets")
    discard(spark, wide)
    involved = open_.select(F.col("rep").alias("id")).distinct()
    texts = materialize(rows.select("id", "text").join(involved, "id", "left_semi"), "texts")
    tested = links = None
    for _ in range(STARS):
        stars = _star_pairs(open_, percent)
        stars = materialize(stars if tested is None else stars.join(tested, ["a", "b"], "left_anti"), "stars")
        with small_batches(spark):
            more = materialize(verify(stars, texts, shingle, percent), "links")
        tested, links = (stars, more) if tested is None else (tested.unionByName(stars), links.unionByName(more))
        found = materialize(connected_components(links), "components")
        # Buckets whose members are not yet in one component.
        before = open_
        labelled = before.drop("label").join(found, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep"))
        labelled = materialize(labelled.select("key", "rep", "n", "lead", "large", "label"), "labelled")
        open_ = materialize(_apart(labelled), "open")
        discard(spark, before, labelled)
    pairs = _small_pairs(open_.filter(~F.col("large")), percent)
    # A pair that also meets in a large bucket is left to the comparison of large buckets.
    pairs = pairs.filter(F.col("met") >= _blocks_in_common(F.col("n_a"), F.col("n_b"), percent))
    pairs = materialize(pairs.select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
    with small_batches(spark):
        links = links.unionByName(materialize(verify(pairs, texts, shingle, percent), "links"))
    members = materialize(open_.filter("large").select("rep", "n", "label").distinct(), "members")
    if not members.isEmpty():
        links = links.unionByName(_family_pairs(members, texts, tested.unionByName(pairs), links, shingle, percent, large))
    final = connected_components(links)
    labels = materialize(classes.join(final, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", "real", F.coalesce("component", "rep").alias("label")), "labels")
    least = materialize(labels.groupBy(F.col("label").alias("l")).agg(F.min("real").alias("least")), "least")
    named = labels.join(least, F.col("label") == F.col("l")).select("n", "s1", "s2", "least")
    linked = sets.select(F.col("real").alias("id"), "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
