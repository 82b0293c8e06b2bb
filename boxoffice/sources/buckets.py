"""Versions of tables in buckets: a change writes the buckets that it touches, and no others.

A table lies in folders by a hash of its key. A version is a list of folders, one for each table and
bucket; a new version lists the folders it has written and, for all other buckets, those of the
version before. Files are Spark's own, and old versions stay readable as long as their folders do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxoffice.functions.scale import materialize, scratch
from boxoffice.sources import schemas
from boxoffice.sources.tables import exists, is_complete

BUCKETS = 256
_LIST = "table_name STRING, bucket INT, folder STRING, buckets INT"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _finish(spark: SparkSession, root: str, folders: list[tuple]) -> None:
    """The list comes last, so that nobody reads half of a version."""
    done = spark.createDataFrame(sorted(folders), _LIST)
    done.coalesce(1).write.mode("overwrite").json(f"{root}/_complete")


def _folders(spark: SparkSession, root: str) -> list[tuple]:
    if not is_complete(spark, root):
        raise FileNotFoundError(f"{root} has no finished version")
    return [tuple(r) for r in spark.read.schema(_LIST).json(f"{root}/_complete").collect()]


def _write(rows: DataFrame, root: str, name: str, key: str, buckets: int) -> list[tuple]:
    """Write rows in buckets below ``root`` and list the folders that there are."""
    spark, path = rows.sparkSession, f"{root}/{name}"
    placed = rows.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", "bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return [(name, k, f"{path}/bucket={k}", buckets) for k in range(buckets) if exists(spark, f"{path}/bucket={k}")]


def write_buckets(tables: dict[str, DataFrame], root: str, buckets: int = BUCKETS, key: str = "id") -> None:
    """Write a whole version in buckets of ``key``. A finished version is not written again."""
    spark, root = next(iter(tables.values())).sparkSession, root.rstrip("/")
    if is_complete(spark, root):
        raise FileExistsError(f"{root} holds a finished version")
    _finish(spark, root, [f for name, df in tables.items() for f in [*_write(df, root, name, key, buckets), (name, -1, "", buckets)]])


def read_buckets(spark: SparkSession, root: str, name: str, only: set[int] | None = None, schema: str | None = None) -> DataFrame:
    """Scan a table of a version, or some of its buckets."""
    folders = [f for t, k, f, _ in _folders(spark, root.rstrip("/")) if t == name and k >= 0 and (only is None or k in only)]
    schema = schema or schemas.TABLES[name]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def change_buckets(
    spark: SparkSession,
    old: str,
    new: str,
    name: str,
    keys: DataFrame,
    change: Callable[[DataFrame], DataFrame],
    key: str = "id",
    schema: str | None = None,
) -> set[int]:
    """A new version ``new`` of ``old`` in which ``change`` was applied to the rows of one table that lie in
    the buckets of ``keys`` (one column). ``change`` maps rows to their new version and may leave out or
    change only rows with one of the keys, or add some. Returns the buckets that were written."""
    old, new = old.rstrip("/"), new.rstrip("/")
    if is_complete(spark, new):
        raise FileExistsError(f"{new} holds a finished version")
    folders = _folders(spark, old)
    buckets = next((n for t, _, _, n in folders if t == name), None)
    if buckets is None:
        raise KeyError(f"{old} has no table {name}")
    touched = {r[0] for r in keys.select(_bucket(keys.columns[0], buckets)).distinct().collect()}
    with scratch(spark):
        rows = materialize(change(read_buckets(spark, old, name, touched, schema)), name)
        written = _write(rows, new, name, key, buckets)
    kept = [f for f in folders if f[0] != name or f[1] not in touched]
    _finish(spark, new, [*kept, *written])
    return touched
