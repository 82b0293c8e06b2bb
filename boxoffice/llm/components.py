"""Connected components by alternating large and small stars, table by table in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from boxoffice.functions.scale import discard, materialize

#: Edges that a task joins at once.
FOREST_EDGES = 1_000_000


def _least_joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of some edges, and of each the least node that these edges join it with."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return names, names[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def _forests(edges: DataFrame) -> DataFrame:
    """Edges that join the same nodes: in each task, nodes hang to the least node that the task's own
    edges join them with. Rows become fewer, and least nodes travel further, before anything is shuffled."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def hang() -> pa.RecordBatch:
            a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            node, least = _least_joined(a, b)
            return pa.record_batch([pa.array(x[node != least]) for x in (node, least)], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in (0, 1)])
            rows += batch.num_rows
            if rows >= FOREST_EDGES:
                yield hang()
                held, rows = [], 0
        if rows:
            yield hang()

    return edges.select("a", "b").mapInArrow(make, "a long, b long")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Of each node (hub) the least of itself and its neighbours, and how many nodes hang to two others or
    hang to one and hold one; if none does, the edges are stars. Minima are taken before the shuffle, and
    written, so that a join shuffles both sides and can split a hub."""
    below = F.when(F.col("b") < F.col("a"), F.col("b"))
    mins = pairs.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least"), F.max(below).alias("most"), F.max("b").alias("top"))
    between = (F.col("most") > F.col("least")) | (F.col("most").isNotNull() & (F.col("top") > F.col("hub")))
    seen = Observation()
    mins = mins.select("hub", F.least("hub", "least").alias("least"), between.alias("between"))
    mins = materialize(mins, "least", seen, F.count_if("between").alias("between"))
    return mins.drop("between"), seen.get["between"]


def _star(pairs: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours (the larger, or the smaller and the node itself) to the least neighbour."""
    joined = pairs.join(least, F.col("a") == F.col("hub"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        below = joined.filter(F.col("b") < F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        out = below.unionByName(least.select(F.col("hub").alias("a"), F.col("least").alias("b")))
    return _forests(out.filter(F.col("a") != F.col("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, not null) to node and component, its least node. Nodes without an edge
    to another are left out; repeated edges and loops do no harm."""
    spark = edges.sparkSession
    edges = materialize(_forests(edges.filter(F.col("a") != F.col("b"))), "edges")
    large = True
    while True:
        least, between = _least(_both_ways(edges))
        if not between:
            discard(spark, edges)
            return least.select(F.col("hub").alias("node"), F.col("least").alias("component"))
        stars = materialize(_star(_both_ways(edges), least, large), "edges")
        discard(spark, edges, least)
        edges, large = stars, not large
