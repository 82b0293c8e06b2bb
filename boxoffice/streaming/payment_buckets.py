"""Payments in buckets, so that a micro-batch reads only what its webhooks can touch.

Payments lie in buckets of their id, and a second, narrow table of intent ids and payment ids in
buckets of the intent id. Buckets are folders; the keys of a batch name the ones that are read, and Spark
prunes the others from the scan. Their number is a parameter, at most that many numbers reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 256


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def with_buckets(payments: DataFrame, buckets: int) -> DataFrame:
    return payments.withColumn("bucket", bucket_of("id", buckets))


def held_intents(payments: DataFrame, buckets: int) -> DataFrame:
    """payment_intent_id, id and bucket of the payments that hold an intent id."""
    held = payments.select("payment_intent_id", "id").filter(F.coalesce("payment_intent_id", F.lit("")) != "")
    return held.withColumn("bucket", bucket_of("payment_intent_id", buckets))


def touched(keys: DataFrame, buckets: int) -> list[int]:
    """The buckets of the keys (one column)."""
    return sorted(r[0] for r in keys.select(bucket_of(keys.columns[0], buckets)).distinct().collect())


@dataclass(frozen=True)
class BucketedPayments:
    """A payments table that ``write_buckets`` has written; ``columns`` is its schema."""

    root: str
    columns: str
    buckets: int = BUCKETS

    def all(self, spark: SparkSession) -> DataFrame:
        table = spark.read.schema(f"{self.columns}, bucket INT").parquet(f"{self.root}/payments")
        return table.drop("bucket")

    def payments(self, spark: SparkSession, ids: DataFrame) -> DataFrame:
        """The buckets of the payments with these ids."""
        table = spark.read.schema(f"{self.columns}, bucket INT").parquet(f"{self.root}/payments")
        return table.filter(F.col("bucket").isin(touched(ids, self.buckets))).drop("bucket")

    def holders(self, spark: SparkSession, intents: DataFrame) -> DataFrame:
        """payment_intent_id and id in the buckets of these intent ids."""
        kind = next(f for f in self.columns.split(", ") if f.split()[0].strip("`") == "id")
        table = spark.read.schema(f"payment_intent_id STRING, {kind}, bucket INT").parquet(f"{self.root}/intents")
        return table.filter(F.col("bucket").isin(touched(intents, self.buckets))).drop("bucket")


def columns_of(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)


def write_buckets(payments: DataFrame, root: str, buckets: int = BUCKETS) -> BucketedPayments:
    """Write a payments table in buckets below ``root``. Each bucket is written by the tasks that Spark
    deals its rows to, several where it is large."""
    root = root.rstrip("/")
    tables = {"payments": with_buckets(payments, buckets), "intents": held_intents(payments, buckets)}
    for name, table in tables.items():
        table.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{root}/{name}")
    return BucketedPayments(root, columns_of(payments), buckets)
