"""Mixing sources to target weights by pivotal dependent rounding.

Each document is due its source's target over its source's size in copies. The whole part is taken as
it is; the fractional parts of a source's documents are rounded together: two documents with fractions
trade words at random, each as likely as keeps its expectation, until one of them has none or a whole
copy. The words of the source stay the same in each trade. Long documents trade first, so that the last one left open is short.
Documents are dealt into small groups; each
group ends with at most one fractional document, and these meet in the groups of the next level of a
tree, until one is left per source, which is rounded by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from boxoffice.functions.scale import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
GROUP_ROWS = 2_000
FAN_IN = 64
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per source: source, n_docs, source_size and target.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes. Targets stop at ``cap`` times the source's size; the excess is shared by weight among the
    rest until none is above. Only sums reach the driver. Without sources there are no rows; if all
    sizes are 0, so are the targets.
    """
    per_source = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ordered = per_source.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source")
    numbered = materialize(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "sources")
    before, offsets = 0, {}
    for row in numbered.groupBy("part").count().orderBy("part").collect():
        offsets[row["part"]] = before
        before += row["count"]
    if not offsets:
        return numbered.select("source", "n_docs", "source_size", F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("part")]
    rank = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + offset
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(rank, F.lit(len(weights))).cast("int")]
    weighed = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    goal = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = goal / weighed.agg(F.sum("weight")).first()[0], 0
    while True:
        above = F.col("weight") * level > F.col("cap")
        sums = weighed.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        if sums[0] == full or not sums[2]:
            break
        full, level = sums[0], (goal - sums[1]) / sums[2]
    return weighed.select("source", "n_docs", "source_size", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def _uniform(ids: np.ndarray, level: int, turn: np.ndarray) -> np.ndarray:
    """Reproducible draws from the id, the level and the place in the group."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + turn.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(level + 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def pivot(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Round ``chances`` in 0..1 by trades that keep the sum of sizes times chances. At most one stays
    fractional."""
    out = chances.copy()
    out[sizes <= 0] = 0.0
    held = -1
    for j in np.flatnonzero((out > _EPS) & (out < 1 - _EPS)).tolist():
        if held < 0:
            held = j
            continue
        a, b, p, q = sizes[held], sizes[j], out[held], out[j]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        move = up if draws[j] * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        out[held], out[j] = p, q
        if not _EPS < p < 1 - _EPS:
            out[held] = round(p)
            held = j if _EPS < q < 1 - _EPS else -1
        if not _EPS < q < 1 - _EPS:
            out[j] = round(q)
    return out


def _settler(level: int, last: bool):
    """Round the documents of one group; in the last level also the fraction that is left."""

    def settle(table: pa.Table) -> pa.Table:
        sizes, ids, hashes = (table[name].to_pylist() for name in ("size", "id", "hash"))
        table = table.take(sorted(range(len(ids)), key=lambda i: (-sizes[i], ids[i] is not None, ids[i] or 0, hashes[i])))
        own = table["id"].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        turn = np.arange(len(own))
        out = pivot(table["size"].to_numpy().astype(float), table["chance"].to_numpy(), _uniform(own, level, turn))
        if last:
            out = np.where((out > 0) & (out < 1), _uniform(own, level + 1000, turn) < out, out).astype(float)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(out))

    return settle


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``id_col``, size (words), source_size, target, copies and taken = copies * size, and the
    columns ``keep`` of docs.

    Null and empty texts have size 0 and are not taken. A null source is a source, the last. Reruns
    agree: draws come from ids, and groups from a hash of id and text and, for rows that are equal
    throughout, their number; rows that repeat an id are rounded each on its own. Empty tables give
    empty results. The words taken from a source differ from its target by less than one document.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"),
            F.struct(*keep).alias("kept") if keep else F.lit(None).cast("struct<none:int>").alias("kept"),
        ),
        "sized",
    )
    # Equal rows are counted before the shuffle and then dealt out over the groups, each with its number.
    sized = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).cast("int").alias("times"))
    sized = materialize(sized.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times"), "sized")
    targets = materialize(source_targets(sized, share, cap, weights), "targets").withColumnRenamed("source", "own")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / GROUP_ROWS))
    rows = (
        sized.join(targets, sized["source"].eqNullSafe(targets["own"]))
        .withColumn("whole", F.floor(due + _EPS).cast("int"))
        .withColumn("chance", F.greatest(F.lit(0.0), due - F.col("whole")))
        .withColumn("bucket", F.pmod(F.xxhash64("hash", "turn"), groups))
        .select("id", "source", "size", "hash", "kept", "source_size", "target", "whole", "chance", "bucket", groups.alias("groups"))
    )
    done, level, most = [], 0, (targets.agg(F.max("n_docs")).first()[0] or 0) / GROUP_ROWS
    while True:
        last = most <= 1

        settled = materialize(rows.groupBy("source", "bucket").applyInArrow(_settler(level, last), rows.schema), "rounded")
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(settled.filter(~open_))
        if last:
            break
        rows, level, most = settled.filter(open_).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)), level + 1, most / FAN_IN
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.col("chance").cast("int")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"kept.{c}").alias(c) for c in keep])
