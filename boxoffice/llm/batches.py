"""Arrow batches of few rows, where rows are long."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs started inside send at most ``rows`` rows at a time to Python; then the session's own
    setting holds again."""
    before = spark.conf.get(_KEY)
    spark.conf.set(_KEY, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_KEY, before)
