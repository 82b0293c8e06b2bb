"""Reading and writing the base tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from boxoffice.sources import schemas


def is_complete(spark: SparkSession, root: str) -> bool:
    """Whether all tables of a version are written."""
    return exists(spark, f"{root.rstrip('/')}/_complete/_SUCCESS")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one base table (or the gateway outcome table) with its declared schema, and the batches
    appended to it. A version that is not wholly written is refused."""
    if not is_complete(spark, root):
        raise FileNotFoundError(f"{root} has no finished version")
    table = spark.read.schema(schemas.TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")
    if not exists(spark, _appended(root, name)):
        return table
    more = spark.read.schema(f"{schemas.TABLES[name]}, batch STRING").parquet(_appended(root, name))
    return table.unionByName(more.drop("batch"))


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    name: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    **options,
) -> DataFrame:
    """The same tables from a relational database. ``partition_column`` and its bounds split the
    scan over the executors."""
    split = {
        "partitionColumn": partition_column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": str(partitions),
    }
    return spark.read.format("jdbc").options(url=url, dbtable=name, **split, **options).load()


def write_version(tables: dict[str, DataFrame], root: str) -> None:
    """Write new table versions below ``root``. The marker comes last, so that ``read_table`` never
    sees half of a set of tables. A finished version is not written again: a new one goes to a new
    root. One that was left unfinished is."""
    spark = next(iter(tables.values())).sparkSession
    if is_complete(spark, root):
        raise FileExistsError(f"{root} holds a finished version")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")
    done = spark.createDataFrame([(n,) for n in sorted(tables)], "table_name STRING")
    done.coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/_complete")


def append(df: DataFrame, root: str, name: str, batch: str) -> None:
    """INSERT: add a batch of rows to a table of a finished version. A batch owns a folder: one that is
    written again takes the place of what it wrote before, and never of another batch's rows."""
    if not is_complete(df.sparkSession, root):
        raise FileNotFoundError(f"{root} has no finished version")
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError("a batch is named by letters, digits, dots, - and _")
    df.write.mode("overwrite").parquet(f"{_appended(root, name)}/batch={batch}")


def _appended(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/_appended/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
