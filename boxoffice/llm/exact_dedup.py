"""Exact deduplication through minimal perfect hashes of the digests met so far.

Documents arrive in batches. A batch is grouped by digest before anything is shuffled, so a text that a third
of all rows share is one row of each task. The digests that the history holds are found by a minimal
perfect hash per shard of the digests' range: its slots hold whole digests, how often they were met and
where the row that stays is (its id and its row number). A digest that is not byte for byte that of its
slot is none of the history's; those are grouped on their own, and the batch's new digests get a hash of
their own next to the older ones. At the end every row looks up where the row that stays of its text is.

Shards have a bounded number of digests, and a shard that hot texts make heavy is read by several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from boxoffice.functions.scale import materialize, shared_dir
from boxoffice.llm import perfect_hash
from boxoffice.llm.batches import small_batches
from boxoffice.llm.files import Reader, Writer, unique_name
from boxoffice.llm.textkit import LOWER, slices, text_bytes

#: Rows of a shard of the digests' range, on average.
SHARD_ROWS = 1 << 18
#: Batches in which the query takes its table: what the first holds is the history of the second.
BATCHES = 2
_KNOWN = ["has_id", "id", "row", "size"]


def text_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the text in UTF-8 with A-Z in lower case) and row, a number of its own."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, at = text_bytes(part.column(1))
            low = memoryview(LOWER[data])
            digests = [hashlib.sha256(low[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([part.column(0), pa.array(digests, pa.binary())], names=["id", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "id long, digest binary").withColumn("row", F.monotonically_increasing_id())


def _shard(digest: Column | str, shards: int) -> Column:
    """Ranges of the first 31 bits, as even as digests are."""
    head = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return F.floor(head * shards / F.lit(1 << 32)).cast("int")


def _words(digests: pa.Array) -> np.ndarray:
    """Digests as rows of four 64-bit words."""
    if isinstance(digests, pa.ChunkedArray):
        digests = digests.combine_chunks()
    return text_bytes(digests)[0].view(np.uint64).reshape(-1, 4) if len(digests) else np.zeros((0, 4), np.uint64)


def _better(new: dict, old: dict) -> np.ndarray:
    """Whether the new row stays: a row with an id before one without, a larger id, an earlier row."""
    same = (new["has_id"] == old["has_id"]) & (new["id"] == old["id"])
    larger = (new["has_id"] > old["has_id"]) | ((new["has_id"] == old["has_id"]) & (new["id"] > old["id"]))
    return larger | (same & (new["row"] < old["row"]))


def _grouped(prints: DataFrame) -> DataFrame:
    """Per digest: the row that stays and how many there are, combined before the shuffle."""
    best = F.max(F.struct(F.col("id").isNotNull().alias("has_id"), F.coalesce("id", F.lit(0)).alias("id"), (-F.col("row")).alias("row")))
    rows = prints.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    return rows.select("digest", "best.has_id", "best.id", (-F.col("best.row")).alias("row"), "size")


def _write_known(folder: str, known: dict[str, np.ndarray]) -> str:
    out = Writer(unique_name(folder, "known"))
    out.add_parts("known", known)
    out.close()
    return out.path


class _Shard:
    """One shard of one batch: the hash with its digests, and what is known of them."""

    def __init__(self, hash_path: str, known_path: str):
        reader = Reader(hash_path)
        self.function, self.digests = reader.parts("hash"), reader.get("digests").reshape(-1, 4)
        self.known = Reader(known_path).parts("known")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of the keys; -1 for those whose digest is not the slot's."""
        slot = perfect_hash.slots(self.function, keys)
        met = np.flatnonzero(slot >= 0)
        other = (self.digests[slot[met]] != keys[met]).any(1)
        slot[met[other]] = -1
        return slot


@dataclass
class DigestIndex:
    """The digests met so far: per batch and shard, the paths of two files. ``add`` takes a batch of prints and
    updates what is known; ``resolve`` says for each print which row stays."""

    folder: str
    shards: int
    batches: list[dict[int, tuple[str, str]]] = field(default_factory=list)

    def add(self, prints: DataFrame) -> None:
        new = _grouped(prints).withColumn("shard", _shard("digest", self.shards))
        for k, files in enumerate(self.batches):
            new = materialize(self._lookup(new, files), "lookup")
            for row in new.filter(F.col("path").isNotNull()).select("shard", "path").collect():
                self.batches[k][row.shard] = (files[row.shard][0], row.path)
            new = new.filter(F.col("path").isNull()).drop("path")
        built = materialize(self._build(new), "hashes").collect()
        self.batches.append({row.shard: (row.path, row.known) for row in built})

    def _build(self, new: DataFrame) -> DataFrame:
        folder = self.folder

        def build(table: pa.Table) -> pa.Table:
            keys = _words(table["digest"])
            function = perfect_hash.build(keys)
            order = np.argsort(perfect_hash.slots(function, keys))
            out = Writer(unique_name(folder, "hash"))
            out.add_parts("hash", function)
            out.add("digests", keys[order].ravel())
            out.close()
            known = _write_known(folder, {n: table[n].to_numpy()[order] for n in _KNOWN})
            return pa.table({"shard": table["shard"][:1], "path": [out.path], "known": [known]})

        return new.groupBy("shard").applyInArrow(build, "shard int, path string, known string")

    def _lookup(self, new: DataFrame, files: dict[int, tuple[str, str]]) -> DataFrame:
        """The rows whose digests a batch does not hold; for those it holds, what is known of the shard
        is written anew, and a row gives the path."""
        folder, names = self.folder, new.columns

        def look(table: pa.Table) -> pa.Table:
            paths = files.get(table["shard"][0].as_py())
            if paths is None:
                return table.append_column("path", pa.nulls(len(table), pa.string()))
            shard = _Shard(*paths)
            slot = shard.find(_words(table["digest"]))
            met, at = slot >= 0, slot[slot >= 0]
            known = {n: np.array(shard.known[n]) for n in _KNOWN}
            mine = {n: table[n].to_numpy()[met] for n in _KNOWN}
            better = _better(mine, {n: known[n][at] for n in _KNOWN})
            for n in _KNOWN[:3]:
                known[n][at[better]] = mine[n][better]
            known["size"][at] += mine["size"]
            rest = table.filter(pa.array(~met)).append_column("path", pa.nulls(int((~met).sum()), pa.string()))
            if not len(at):
                return rest
            note = {n: pa.nulls(1, table.schema.field(n).type) for n in names}
            note |= {"shard": table["shard"][:1], "path": pa.array([_write_known(folder, known)])}
            return pa.concat_tables([rest, pa.table(note, rest.schema)])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.schema)
        return new.groupBy("shard").applyInArrow(look, f"{fields}, path string")

    def resolve(self, prints: DataFrame, rows: int) -> DataFrame:
        """The prints with keep_id, group_size and kept; a digest that was never met has size 0."""
        spark = prints.sparkSession
        placed = prints.withColumn("shard", _shard("digest", self.shards))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_ROWS))
        # A shard with more rows than a task should take is read by several.
        load = max(1, rows // parts)
        heavy = placed.groupBy("shard").count().filter(F.col("count") > load).collect()
        tasks = {r["shard"]: -(-r["count"] // load) for r in heavy}
        shares = F.create_map(*[F.lit(x) for item in tasks.items() for x in item])[F.col("shard")] if tasks else F.lit(1)
        salt = F.pmod(F.xxhash64("row"), F.coalesce(shares, F.lit(1)))
        dealt = placed.withColumn("salt", salt).repartition(parts, "shard", "salt").sortWithinPartitions("shard").drop("salt")
        batches = self.batches

        def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, own = None, []
            for batch in parts:
                shard = batch.column(3).to_numpy()
                cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
                for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                    part = batch.slice(a, b - a)
                    if held != shard[a]:
                        held, own = shard[a], [_Shard(*files[shard[a]]) for files in batches if shard[a] in files]
                    keys, left = _words(part.column(1)), np.arange(b - a)
                    found = {n: np.zeros(b - a, np.int64) for n in _KNOWN}
                    for one in own:
                        slot = one.find(keys[left])
                        for n in _KNOWN:
                            found[n][left[slot >= 0]] = one.known[n][slot[slot >= 0]]
                        left = left[slot < 0]
                    keep = pa.array(found["id"], mask=found["has_id"] == 0)
                    stays = pa.array((part.column(2).to_numpy() == found["row"]) & (found["size"] > 0))
                    yield pa.record_batch([part.column(0), part.column(1), keep, pa.array(found["size"]), stays], names=["id", "digest", "keep_id", "group_size", "kept"])

        return dealt.mapInArrow(look, "id long, digest binary, keep_id long, group_size long, kept boolean")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per row: ``id_col``, keep_id (the id of the row that stays), group_size, kept, and text_sha256.

    Texts are equal if they are when A-Z are folded; a null counts as empty. The row with the largest id
    stays; rows without an id come after all others, and keep_id is null where no row has one. Of rows
    that repeat the largest id one stays. Rows come in ``batches`` by a hash of their id and number.
    """
    counts = Observation()
    with small_batches(docs.sparkSession):
        prints = materialize(text_prints(docs, id_col, text_col), "prints", counts, F.count(F.lit(1)).alias("rows"))
    rows = counts.get["rows"]
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // shard_rows))
    index = DigestIndex(f"{shared_dir(docs.sparkSession)}/digests", shards)
    turn = F.pmod(F.xxhash64("id", "row"), F.lit(batches))
    for k in range(batches):
        index.add(prints.filter(turn == k))
    found = index.resolve(prints, rows)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
