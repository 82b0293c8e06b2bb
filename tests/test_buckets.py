from __future__ import annotations

from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boxoffice.operators import dml
from boxoffice.sources import schemas
from boxoffice.sources.buckets import change_buckets, read_buckets, write_buckets
from tests.conftest import rows

T0, NOW = datetime(2024, 1, 1), datetime(2024, 2, 1)


def event(k, title="Rock"):
    return (f"e{k}", title, "x", None, T0, None, "u1")


def files(root) -> set[str]:
    return {str(f.relative_to(root)) for f in Path(root).rglob("*.parquet")}


@pytest.fixture
def version(table, tmp_path):
    events = table(schemas.EVENTS, *[event(k) for k in range(200)])
    details = table(schemas.EVENT_DETAILS, *[(f"d{k}", T0, Decimal(1), 9, 9, "t", T0, None, f"e{k}") for k in range(50)])
    write_buckets({"events": events, "event_details": details}, str(tmp_path / "v1"), 32)
    return str(tmp_path / "v1")


def test_one_edit_writes_one_bucket(spark, table, version, tmp_path):
    edits = table("seq INT, id STRING, user_id STRING, title STRING, description STRING, organizer STRING", (1, "e7", "u1", "Jazz", "y", "Org"))
    new = str(tmp_path / "v2")
    touched = change_buckets(spark, version, new, "events", edits.select("id"), lambda old: dml.update_event(old, edits, NOW).drop("updated"))
    assert len(touched) == 1 and len(files(new)) == 1 and all(f"bucket={k}" in f for k in touched for f in files(new))
    want = dml.update_event(read_buckets(spark, version, "events"), edits, NOW).drop("updated")
    assert rows(read_buckets(spark, new, "events")) == rows(want)
    assert rows(read_buckets(spark, new, "events").filter("id = 'e7'"), "title", "organizer") == {("Jazz", "Org")}
    # The version before and the other table stand as they were.
    assert rows(read_buckets(spark, version, "events"), "title") == {("Rock",)}
    assert read_buckets(spark, new, "event_details").count() == 50


def test_chain_of_versions(spark, table, version, tmp_path):
    """Deletes, inserts and edits over several versions equal the same on one table."""
    model, old = {f"e{k}": "Rock" for k in range(200)}, version
    for step in range(4):
        gone, edited, added = [f"e{k}" for k in range(step * 3, step * 3 + 2)], f"e{100 + step}", event(f"n{step}", "New")
        keys = table("id STRING", *[(k,) for k in [*gone, edited, added[0]]])
        extra = table(schemas.EVENTS, added)

        def change(rows, gone=gone, edited=edited, extra=extra, step=step):
            kept = rows.filter(~F.col("id").isin(gone)).withColumn("title", F.when(F.col("id") == edited, f"T{step}").otherwise(F.col("title")))
            return kept.unionByName(extra)

        new = str(tmp_path / f"w{step}")
        change_buckets(spark, old, new, "events", keys, change)
        for k in gone:
            model.pop(k, None)
        model |= {edited: f"T{step}", added[0]: "New"}
        old = new
        assert rows(read_buckets(spark, old, "events"), "id", "title") == set(model.items())


def test_emptied_bucket_and_refusals(spark, table, version, tmp_path):
    new = str(tmp_path / "v2")
    keys = read_buckets(spark, version, "events").select("id")
    change_buckets(spark, version, new, "events", keys, lambda old: old.limit(0))
    assert read_buckets(spark, new, "events").count() == 0 and files(new) == set()
    # The emptied table still takes rows.
    change_buckets(spark, new, str(tmp_path / "v3"), "events", table("id STRING", ("z",)), lambda old: old.unionByName(table(schemas.EVENTS, event("z"))))
    assert read_buckets(spark, str(tmp_path / "v3"), "events").count() == 1
    with pytest.raises(FileExistsError):
        change_buckets(spark, version, new, "events", keys, lambda old: old)
    with pytest.raises(FileNotFoundError):
        read_buckets(spark, str(tmp_path / "none"), "events")
    with pytest.raises(KeyError):
        change_buckets(spark, version, str(tmp_path / "v4"), "users", keys, lambda old: old)


def test_some_buckets_are_read(spark, version):
    part = read_buckets(spark, version, "events", {0, 1})
    assert 0 < part.count() < 60 and len(part.inputFiles()) <= 2
