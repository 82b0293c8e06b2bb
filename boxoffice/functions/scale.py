"""Helpers that keep a job even and restartable on a large cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

SPLIT_ROWS = 2_000_000
SLICE = "_slice"
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir, with its
    file system: a name without one is in the cluster's default file system, and not on each machine's
    own disk. A local session that names none gets a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="boxoffice-"))
        named = context.getCheckpointDir()
    folder = context._jvm.org.apache.hadoop.fs.Path(named)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")


def materialize(df: DataFrame, label: str, counts: Observation | None = None, *metrics) -> DataFrame:
    """Write a table once and read it back: no lineage, and sizes the planner can trust.
    ``metrics`` are aggregates gathered into ``counts`` by the same write."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    (df.observe(counts, *metrics) if counts else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop
    for path in paths:
        folder = hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialize`` writes inside when the block ends; results must be
    written before. Blocks may stand in each other."""
    token = _written.set([])
    try:
        yield
    finally:
        _delete(spark, _written.get() or [])
        _written.reset(token)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, written; the tables that it wrote on its way are deleted."""
    outer = _written.get()
    with scratch(spark):
        df = make()
        inner = _written.set(outer)
        try:
            return materialize(df, label)
        finally:
            _written.reset(inner)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing needs any more, before their block ends. Tables
    written outside of a block stay."""
    own = {path.rsplit("/", 1)[1]: path for path in _written.get() or []}
    folders = {file.rsplit("/", 2)[-2] for df in tables for file in df.inputFiles()}
    _delete(spark, [own[name] for name in folders if name in own])


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input that arrives in fewer splits than there are cores, before heavy work on
    each row. A large input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slice_hot_keys(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    split_rows: int = SPLIT_ROWS,
    probe: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Prepare ``df`` for ``running``: if a key has more rows than one task should sort,
    cut the rows into ranges of (key, order) and note the range in ``_slice``.

    ``probe`` is a cheaper table whose rows per key are about those of ``df``; its columns are
    all keys. ``rows`` is the number of rows where it is known: too few for a hot key need no
    count. The ranges are written before use, so that both passes of ``running`` see the same cut.
    """
    if rows is not None and rows <= split_rows:
        return df
    probe = df.select(*keys) if probe is None else probe
    counts = probe.groupBy(*probe.columns).count()
    total, largest = counts.agg(F.sum("count"), F.max("count")).first()
    if (largest or 0) <= split_rows:
        return df
    # The number is given, so that adaptive execution does not merge the ranges again.
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(default, 1 + total // max(split_rows, SPLIT_ROWS))
    ranged = df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    # A range of the usual size holds several slices where fewer rows are asked for, so that tasks stay few.
    at, mask = F.col(SLICE), F.lit((1 << 33) - 1)
    own = at - at.bitwiseAND(mask) + F.floor(at.bitwiseAND(mask) / split_rows)
    return materialize(ranged.withColumn(SLICE, F.monotonically_increasing_id()).withColumn(SLICE, own), "slices")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
) -> DataFrame:
    """Per key, over the rows strictly before each row in ``order``: running sums and the last
    value that is not NULL; ``nexts`` looks at the rows strictly after instead.

    Where ``slice_hot_keys`` has cut the rows, each slice is summarized first and only the
    summaries (one row per key and slice) pass through a per-key window.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    inputs = {**sums, **lasts, **nexts}
    work = df.select("*", *[c.alias(f"_in_{n}") for n, c in inputs.items()])
    drop = [f"_in_{n}" for n in inputs]

    def over(frame: DataFrame, parts: list[str], by: list[str], prefix: str) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*by)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        after = w.rowsBetween(1, Window.unboundedFollowing)
        return frame.select(
            "*",
            *[F.sum(f"_in_{n}").over(before).alias(prefix + n) for n in sums],
            *[F.last(f"_in_{n}", True).over(before).alias(prefix + n) for n in lasts],
            *[F.first(f"_in_{n}", True).over(after).alias(prefix + n) for n in nexts],
        )

    if SLICE not in df.columns:
        out = over(work, keys, order, "")
        for n in sums:
            out = out.withColumn(n, F.coalesce(n, F.lit(0)))
        return out.drop(*drop)

    spot = F.struct(*order)
    digest = work.groupBy(*keys, SLICE).agg(
        *[F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), spot)).alias(f"_in_{n}")
            for n in lasts
        ],
        *[
            F.min_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), spot)).alias(f"_in_{n}")
            for n in nexts
        ],
    )
    carried = over(digest, keys, [SLICE], "_far_").drop(*drop)
    near = over(work, [*keys, SLICE], order, "_near_")
    out = near.join(carried, [*keys, SLICE])
    for n in inputs:
        near_n, far_n = F.col(f"_near_{n}"), F.col(f"_far_{n}")
        if n in sums:
            value = F.coalesce(near_n, F.lit(0)) + F.coalesce(far_n, F.lit(0))
        else:
            value = F.coalesce(near_n, far_n)
        out = out.withColumn(n, value)
    return out.drop(*drop, *[f"_near_{n}" for n in inputs], *[f"_far_{n}" for n in inputs])


def arrival_numbers(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Number the rows from ``start`` in ``order`` without gathering them: partitions are ranges, and
    only their row counts reach the driver. The ranges are written once, so that numbers hold."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "arrivals")
    offsets, before = [], start
    for row in placed.groupBy("_part").count().orderBy("_part").collect():
        offsets += [F.lit(row["_part"]), F.lit(before)]
        before += row["count"]
    if not offsets:
        return df.limit(0).withColumn(name, F.lit(0).cast("long"))
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, (at + F.create_map(*offsets)[F.col("_part")]).cast("long")).drop("_part", "_at")
