"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows that lie by payment are joined by payment and action where they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # What a finished query has shuffled is deleted at once, not when the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: Shuffles begin with this many partitions a core, which adaptive execution merges by their size.
FIRST_PARTS = 8


def prepare(spark: SparkSession) -> SparkSession:
    """Set what can be set on a running session; sizes and partition counts stay the cluster's. Only the
    number that shuffles begin with is raised, so that a task's share does not grow with the input."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    parts = max(FIRST_PARTS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    return spark


def local_session(cores: int | str = 8, app: str = "boxoffice") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
