"""Whitening of embeddings on the principal components of their exact integer grid.

The covariance is never formed. Jacobi-Davidson in the driver asks for its products with a block of a few
vectors; each product is a job in which tasks centre their rows, multiply and sum, and Spark adds up the
tasks' sums entry by entry. The driver holds vectors of the dimension alone, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from boxoffice.functions.scale import materialize
from boxoffice.llm.batches import small_batches
from boxoffice.llm.jacobi_davidson import largest_eigenpairs

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Grid values beyond this are held at it, so that they and their distances are exact as doubles.
FARTHEST = 1 << 51
#: Components with less variance than this share of the largest cannot be told from none.
LEAST_VARIANCE = 1e-13


def _matrix(column: pa.Array, size: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, size)


def grid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, x (array of long) and size, of the vectors that are whole and finite."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            batch = batch.filter(pc.is_valid(column))
            column = batch.column(1)
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            wrong = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
            owner = np.repeat(np.arange(len(size)), size)
            keep = np.bincount(owner, weights=wrong, minlength=len(size)) == 0
            grid = np.floor(SCALE * np.where(wrong, 0, flat.fill_null(0).to_numpy(zero_copy_only=False)))
            x = np.clip(grid, -FARTHEST, FARTHEST).astype(np.int64)[keep[owner]] + OFFSET
            at = pa.array(np.append(0, np.cumsum(size[keep])), pa.int32())
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(at, pa.array(x)), pa.array(size[keep])], names=["id", "x", "size"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(make, f"id {rows.schema['id'].dataType.simpleString()}, x array<bigint>, size bigint")


def _added(rows: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what ``make`` says of a batch. Tasks add up their own batches, and Spark adds
    tasks entry by entry, so no task takes the sums of all others."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    with small_batches(rows.sparkSession):
        added = rows.select("x").mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[added["at"].to_numpy()] = added["value"].to_numpy()
    return out.reshape(shape)


def _sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """How many rows, and the exact sums of x per dimension: upper and lower halves are added on their own."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), size, np.int64)
            n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(low), pa.array(high)], names=["at", "n", "low", "high"])

    with small_batches(rows.sparkSession):
        parts = rows.select("x").mapInArrow(halves, "at long, n long, low long, high long")
        wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "low", "high")]
        found = sorted(parts.groupBy("at").agg(*wide).collect())
    return int(found[0].n), [int(r.low) + (int(r.high) << 32) for r in found]


@dataclass(frozen=True)
class Whitening:
    """What is fitted: rows, exact sums, eigenvalues (falling), eigenvectors (columns) and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, column: pa.Array) -> np.ndarray:
        """x - S / n: the distance to the mean's whole part is exact, and only then the rest goes off."""
        return _centred(column, self.n, self.sums)

    def whiten(self, column: pa.Array) -> np.ndarray:
        return self.centred(column) @ (self.vectors / np.sqrt(self.values))


def _centred(column: pa.Array, n: int, sums: list[int]) -> np.ndarray:
    x = _matrix(column, len(sums), np.int64)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def _deviations(column: pa.Array, n: int, sums: list[int]) -> pa.Array:
    """The exact sums of (n x - S)^2, null where they are beyond a long. Whole numbers wrap around, so the sum is
    right if it fits at all."""
    x = _matrix(column, len(sums), np.int64)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    near = ((n * (x - whole).astype(float) - rest) ** 2).sum(1)
    with np.errstate(over="ignore"):
        exact = ((np.int64(n) * (x - whole) - rest) ** 2).sum(1)
    return pa.array(exact, mask=~((near < 2.0**63 * (1 - 1e-9)) & (exact >= 0)))


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The principal components of ``grid_vectors`` of one size; None without rows."""
    if size == 0 or rows.isEmpty():
        return None
    n, sums = _sums(rows, size)
    trace = _added(rows, lambda b: np.array([(_centred(b.column(0), n, sums) ** 2).sum()]), (1,))[0] / n
    if trace == 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)

    def product(block: np.ndarray) -> np.ndarray:
        def make(batch: pa.RecordBatch) -> np.ndarray:
            c = _centred(batch.column(0), n, sums)
            return c.T @ (c @ block)

        return _added(rows, make, block.shape) / n

    values, vectors = largest_eigenpairs(product, size, components)
    real = values > LEAST_VARIANCE * values[0]
    return Whitening(n, sums, values[real], vectors[:, real], trace)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity, by its largest entry."""
    k = len(model.values)
    mean = _added(rows, lambda b: model.whiten(b.column(0)).sum(0), (k,)) / model.n

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = model.whiten(batch.column(0)) - mean
        return w.T @ w

    return float(np.abs(_added(rows, moments, (k, k)) / model.n - np.eye(k)).max())


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: ``id_col``, component, n, deviation, whitened, explained, identity_error.

    Left out are null vectors, those with null or non-finite entries and, where lengths differ, all but
    those of the most frequent length (of equally frequent ones the longest). Entries become
    floor(64 c) + 1000000. Repeated and null ids are rows like others. There are at most as many
    components as dimensions, and those without variance are left out, since they cannot be scaled: one
    row, or equal rows, have none. A deviation beyond a long is null.
    """
    spark = vectors.sparkSession
    with small_batches(spark):
        grid = materialize(grid_vectors(vectors, id_col, vec_col), "grid")
    lengths = grid.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = grid.filter(F.col("size") == (lengths["size"] if lengths else 0)).select("x", "id")
    model = fit(rows, lengths["size"] if lengths else 0, components)
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        out = spark.createDataFrame([], fields)
        return out.withColumnRenamed("id", id_col)
    k, wrong = len(model.values), identity_error(rows, model)
    explained = model.values / model.trace

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            owner = pa.array(np.repeat(np.arange(size), k))
            columns = [
                batch.column(1).take(owner),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, model.n)),
                _deviations(batch.column(0), model.n, model.sums).take(owner),
                pa.array(model.whiten(batch.column(0)).ravel()),
                pa.array(np.tile(explained, size)),
                pa.array(np.full(size * k, wrong)),
            ]
            yield pa.record_batch(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(make, fields).withColumnRenamed("id", id_col)
