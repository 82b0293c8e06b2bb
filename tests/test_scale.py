import random
import time

import pytest
from pyspark.sql import functions as F

from boxoffice.functions.scale import SLICE, materialize, running, shared_dir, slice_hot_keys
from tests.conftest import rows


@pytest.fixture
def skewed(spark):
    rng = random.Random(5)
    data = [
        ("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", i, rng.randrange(5),
         rng.choice([None, "a", "b", "c"]))
        for i in range(1500)
    ]
    return spark.createDataFrame(data, "k STRING, n INT, q INT, t STRING")


def answer(df):
    got = running(
        df, ["k"], ["n"],
        sums={"before": F.col("q")}, lasts={"held": F.col("t")}, nexts={"then": F.col("t")},
    )
    return rows(got, "k", "n", "before", "held", "then")


def test_sliced_running_equals_plain_running(skewed):
    sliced = slice_hot_keys(skewed, ["k"], ["n"], split_rows=100)
    assert SLICE in sliced.columns
    hot = sliced.filter("k = 'hot'").select(SLICE).distinct().count()
    assert hot > 1
    plain = slice_hot_keys(skewed, ["k"], ["n"])
    assert SLICE not in plain.columns
    assert answer(sliced) == answer(plain)


def test_running_against_a_loop(skewed):
    want, seen = set(), {}
    for k, n, q, t in sorted(skewed.collect(), key=lambda r: r.n):
        total, held = seen.get(k, (0, None))
        want.add((k, n, total, held))
        seen[k] = (total + q, held if t is None else t)
    assert {r[:4] for r in answer(skewed)} == want


def test_materialize_uses_the_named_folder(spark, skewed):
    again = materialize(skewed, "t")
    assert again.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark))
    assert rows(again) == rows(skewed)


def test_small_slices_share_ranges(spark):
    """Slices of few rows lie several in a range: tasks do not grow with the number of slices."""
    rows = spark.range(2_000).selectExpr("id % 3 as k", "id as n")
    cut = slice_hot_keys(rows, ["k"], ["n"], 50)
    sizes = [r["count"] for r in cut.groupBy(SLICE).count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 50 and len(cut.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r.k, r.n, r.before) for r in running(cut, ["k"], ["n"], sums={"before": F.lit(1)}).collect()}
    assert got == {(n % 3, n, n // 3) for n in range(2_000)}


def test_shuffles_begin_with_more_partitions(spark):
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 8 * spark.sparkContext.defaultParallelism


def test_shuffle_files_go_with_their_query(spark):
    """What a query has shuffled is deleted when it ends, and a result that is read again is worked out again."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set:
        found = disk.getAllFiles()
        return {name for name in (found.apply(k).getName() for k in range(found.size())) if name.endswith(".data")}

    before = files()
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    first = sorted(map(tuple, counted.collect()))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert sorted(map(tuple, counted.collect())) == first == [(k, 100) for k in range(10)]
