from datetime import datetime
from decimal import Decimal

import pytest

from boxoffice.sources.derived import Derived
from boxoffice.functions.scale import shared_dir, spread
from boxoffice.sources import schemas
from boxoffice.sources.tables import append, read_table, write_version
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def test_versions_round_trip(spark, table, tmp_path):
    events = table(schemas.EVENTS, ("e1", "Rock", "x", None, T0, None, "u1"))
    payments = table(
        schemas.PAYMENTS, ("p1", None, Decimal("1.50"), "usd", "pending", T0, T0, None, "u1")
    )
    write_version({"events": events, "payments": payments}, str(tmp_path / "v1"))
    assert rows(read_table(spark, str(tmp_path / "v1"), "events")) == rows(events)
    again = read_table(spark, str(tmp_path / "v1"), "payments")
    assert rows(again) == rows(payments)
    assert again.schema.simpleString() == payments.schema.simpleString()
    done = spark.read.json(str(tmp_path / "v1" / "_complete"))
    assert rows(done, "table_name") == {("events",), ("payments",)}
    with pytest.raises(FileExistsError):
        write_version({"events": events}, str(tmp_path / "v1"))
    events.write.parquet(str(tmp_path / "v2" / "events"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "v2"), "events")
    write_version({"events": events}, str(tmp_path / "v2"))  # what was left unfinished is done again
    assert read_table(spark, str(tmp_path / "v2"), "events").count() == 1


def test_appends_can_be_run_again(spark, table, tmp_path):
    def log(i, amount="1.00"):
        return (i, "succeeded", None, "pi", None, Decimal(amount), T0, "a@x.com", "p1")

    root = str(tmp_path / "v1")
    first = table(schemas.PAYMENT_LOGS, log("l0"))
    with pytest.raises(FileNotFoundError):
        append(first, root, "payment_logs", "0")
    write_version({"payment_logs": first}, root)
    for _ in range(2):
        append(table(schemas.PAYMENT_LOGS, log("l1"), log("l2")), root, "payment_logs", "2024-01-01")
    append(table(schemas.PAYMENT_LOGS, log("l1")), root, "payment_logs", "7")
    got = read_table(spark, root, "payment_logs")
    assert sorted(r.id for r in got.collect()) == ["l0", "l1", "l1", "l2"]
    assert got.schema.simpleString() == first.schema.simpleString()
    # What a batch writes the second time takes the first one's place, even if it is less.
    append(table(schemas.PAYMENT_LOGS), root, "payment_logs", "7")
    assert sorted(r.id for r in read_table(spark, root, "payment_logs").collect()) == ["l0", "l1", "l2"]
    with pytest.raises(ValueError, match="named"):
        append(first, root, "payment_logs", "../x")


def test_scan_reads_only_what_is_asked(spark, table, tmp_path, capsys):
    events = table(schemas.EVENTS, ("e1", "Rock", "x", None, T0, None, "u1"))
    write_version({"events": events}, str(tmp_path / "v1"))
    read_table(spark, str(tmp_path / "v1"), "events").filter("user_id = 'u1'").select(
        "title"
    ).explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<title:string,user_id:string>" in plan
    assert "EqualTo(user_id,u1)" in plan


def test_shared_dir_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = (named or spark.sparkContext.getCheckpointDir()).rstrip("/")
    assert shared_dir(spark) == (folder if ":" in folder else f"file:{folder}")


def test_shared_dir_names_its_file_system(spark, tmp_path):
    """A folder without a scheme belongs to the default file system, wherever tasks then open it."""

    class Session:
        sparkContext = spark.sparkContext
        conf = {"spark.checkpoint.dir": "/shared/ck/"}

    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    default = hadoop.get("fs.defaultFS")
    try:
        assert shared_dir(Session()) == "file:/shared/ck"
        hadoop.set("fs.viewfs.mounttable.other.link./shared", f"file://{tmp_path}")
        hadoop.set("fs.defaultFS", "viewfs://other/")
        assert shared_dir(Session()) == "viewfs://other/shared/ck"
    finally:
        hadoop.set("fs.defaultFS", default)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_spread_leaves_wide_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 100, 1, cores + 3)).rdd.getNumPartitions() == cores + 3


def test_reservations_join_as_numbers(spark, tmp_path, capsys):
    """The id of a reservation is a text that is made after the join with payers."""
    for name, schema in (("orders", schemas.ORDERS), ("lineitem", schemas.LINEITEM)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    Derived(spark, str(tmp_path)).reservations.explain()
    plan = capsys.readouterr().out
    assert "concat_ws" in plan and plan.rindex("concat_ws") < plan.index("Join")
