from __future__ import annotations

import json
import re
from datetime import datetime

import pytest

from boxoffice.operators import outbox
from boxoffice.operators.webhook_fold import fold_webhooks
from boxoffice.sources import schemas
from boxoffice.sources.webhooks import parse_webhooks, read_webhook_files
from boxoffice.streaming.payment_buckets import BucketedPayments, bucket_of, held_intents, with_buckets, write_buckets
from boxoffice.streaming.webhook_stream import Notices, WebhookStore, apply_webhook_stream, compact, current_payments, payments_for
from tests.conftest import rows
from tests.test_webhooks import INTENT, NOW, PAYMENTS, T0, intent, loop, payment, refund_failed, refunded, traffic

RESERVATIONS = schemas.RESERVATIONS.replace("payment_id STRING", "payment_id BIGINT")
DETAILS = "id STRING, title STRING, ticket_description STRING, show_date TIMESTAMP_NTZ"


@pytest.fixture
def users(table):
    return table(schemas.USERS, ("u1", "Ann", "Lee", "ann@x.com", "h", T0, None))


def deliver(spark, tmp_path, store, base, users, parts, **options):
    """Each part arrives as a file, and the stream is started anew for it."""
    inbox = tmp_path / "in"
    inbox.mkdir(exist_ok=True)
    seq = sum(len(f.read_text().splitlines()) for f in inbox.iterdir())
    for part in parts:
        lines = [json.dumps({"seq": seq + k, "channel": "payment", "value": v if isinstance(v, str) else json.dumps(v)}) for k, v in enumerate(part)]
        (inbox / f"{seq}.json").write_text("\n".join(lines))
        seq += len(part)
        job = apply_webhook_stream(read_webhook_files(spark, str(inbox)), base, users, store, str(tmp_path / "ck"), **{"as_of": NOW, **options})
        job.trigger(availableNow=True).start().awaitTermination()


def tickets(table, payments):
    held = [(f"r{i}-{k}", "e", T0, None, f"d{(i + k) % 3}", "u1", i) for i, *_ in payments for k in range(i % 4)]
    details = [(f"d{k}", "Rock", ("floor", "lounge", "box")[k], T0) for k in range(3)]
    return table(RESERVATIONS, *held), table(DETAILS, *details)


def test_notices_equal_those_of_one_batch(spark, table, users, tmp_path):
    payments, events = traffic(11, 12, 90)
    base, store = table(PAYMENTS, *payments), WebhookStore(str(tmp_path / "out"))
    reservations, details = tickets(table, payments)
    deliver(spark, tmp_path, store, base, users, [events[:30], events[30:60], events[60:]], notices=Notices(reservations, details))
    raw = table("seq BIGINT, value STRING", *[(k, e if isinstance(e, str) else json.dumps(e)) for k, e in enumerate(events)])
    applied = fold_webhooks(parse_webhooks(raw), base, users, NOW).applied
    want = outbox.webhook_mails(applied, base, users, reservations, details)
    got = spark.read.parquet(store.path("outbox")).drop("batch")
    assert rows(got.select(*want.columns)) == rows(want) and got.count() == want.count() > 10
    assert got.select("mail_key").distinct().count() == got.count()
    assert {r.subject for r in got.collect()} == {r.subject for r in want.collect()} and len({r.subject for r in want.collect()}) == 3


def test_a_batch_run_twice_gives_one_mail(spark, table, users, tmp_path):
    base, store = table(PAYMENTS, payment(1, "a"), payment(3, "c")), WebhookStore(str(tmp_path / "out"))
    reservations, details = tickets(table, [(1,), (3,)])
    part = [[intent(INTENT[0], 1, "a"), refund_failed("c"), intent(INTENT[1], 3, "c", error="No funds.")]]
    deliver(spark, tmp_path, store, base, users, part, notices=Notices(reservations, details))
    first = rows(spark.read.parquet(store.path("outbox")))
    # The commit of the batch is lost; the stream runs it again.
    for f in (tmp_path / "ck" / "commits").iterdir():
        f.unlink()
    deliver(spark, tmp_path, store, base, users, [[intent(INTENT[2], 1, "a")]], notices=Notices(reservations, details))
    assert rows(spark.read.parquet(store.path("outbox"))) == first and len(first) == 3


def test_repeats_over_batches_and_restarts(spark, table, users, tmp_path):
    """Every part is a run of the stream of its own; the state outlives it."""
    def named(event, name):
        return {"id": name, **event}

    base, store = table(PAYMENTS, payment(1, "a", "refund pending"), payment(2, "b")), WebhookStore(str(tmp_path / "out"))
    parts = [
        [named(refunded("a"), "evt_1"), named(intent(INTENT[1], 2, "b"), "evt_2"), named(intent(INTENT[1], 2, "b"), "evt_2")],
        [named(intent(INTENT[0], 2, "b", 2000), "evt_3")],
        ["{broken", intent(INTENT[2], 2, "b"), intent(INTENT[2], 2, "b")],
        [named(refunded("a"), "evt_1"), named(intent(INTENT[1], 2, "b"), "evt_2"), "{broken"],
    ]
    deliver(spark, tmp_path, store, base, users, parts, repeats_within="1 hour")
    logs = spark.read.parquet(store.path("logs")).groupBy("payment_id", "status").count()
    assert rows(logs) == {(1, "succeeded", 1), (2, "payment_failed", 1), (2, "succeeded", 1), (2, "requires_action", 2)}
    # Bodies that name no event are all kept.
    assert spark.read.parquet(store.path("quarantine")).filter("reason = 'bad_json'").count() == 2
    assert rows(current_payments(base, store), "id", "status") == {(1, "refunded"), (2, "requires_action")}


def test_repeats_are_applied_by_default(spark, table, users, tmp_path):
    base, store = table(PAYMENTS, payment(2, "b")), WebhookStore(str(tmp_path / "out"))
    again = {"id": "evt", **intent(INTENT[1], 2, "b")}
    deliver(spark, tmp_path, store, base, users, [[again], [again]])
    assert spark.read.parquet(store.path("logs")).count() == 2


def test_stream_over_buckets_equals_a_loop(spark, table, users, tmp_path):
    payments, events = traffic(12, 40, 90)
    want, _, _ = loop(payments, events)
    base = write_buckets(table(PAYMENTS, *payments), str(tmp_path / "base"), 16)
    store = WebhookStore(str(tmp_path / "out"), buckets=8)
    deliver(spark, tmp_path, store, base, users, [events[:30], events[30:60]])
    newer = compact(base, store, str(tmp_path / "base2"), 2, spark)
    base = BucketedPayments(str(tmp_path / "base2"), base.columns, 16)
    deliver(spark, tmp_path, newer, base, users, [events[60:]])
    assert rows(current_payments(base, newer, spark=spark), "id", "status", "amount", "payment_intent_id") == want


def test_a_batch_reads_the_buckets_of_its_keys(spark, table, tmp_path):
    """One event among 400 payments: both tables are pruned to one bucket, in the base and in the changes."""
    payments = table(PAYMENTS, *[payment(k, f"pi_{k}") for k in range(400)])
    base = write_buckets(payments, str(tmp_path / "base"), 16)
    store = WebhookStore(str(tmp_path / "out"), buckets=16)
    changed = payments.filter("id < 100")
    with_buckets(changed, 16).write.partitionBy("bucket").parquet(store.path("payments", 0))
    held_intents(changed, 16).write.partitionBy("bucket").parquet(store.path("intents", 0))
    typed = parse_webhooks(table("seq BIGINT, value STRING", (0, json.dumps(refunded("pi_7")))))
    found = payments_for(typed, base, store, 1)
    assert [r.id for r in found.collect()] == [7]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = found.select("id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    own = spark.range(7, 8).select(bucket_of("id", 16)).first()[0]
    scans = [x for x in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if x]
    assert len(scans) >= 2 and all(re.search(rf"bucket#\d+ = {own}\b", x) for x in scans)
    carried = table("payment_intent_id STRING", ("pi_7",))
    assert base.holders(spark, carried).count() < 60 and base.payments(spark, spark.range(7, 8)).count() < 60


def test_clock_is_that_of_the_messages(spark, table, users, tmp_path):
    """Without as_of a batch that is run again writes the same times."""
    base, store = table(PAYMENTS, payment(1, "a")), WebhookStore(str(tmp_path / "out"))
    with pytest.raises(ValueError, match="as_of"):
        deliver(spark, tmp_path, store, base, users, [[intent(INTENT[0], 1, "a")]], as_of=None)
    (tmp_path / "topic").mkdir()
    lines = [{"timestamp": f"2024-01-05T10:00:0{k}.000Z", "topic": "p", "partition": 0, "offset": k, "value": json.dumps(intent(INTENT[k], 1, "a"))} for k in range(2)]
    (tmp_path / "topic" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    raw = spark.readStream.schema("timestamp TIMESTAMP, topic STRING, partition INT, offset LONG, value STRING").json(str(tmp_path / "topic"))
    store = WebhookStore(str(tmp_path / "timed"))
    apply_webhook_stream(raw, base, users, store, str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    at = datetime(2024, 1, 5, 10, 0, 1)
    assert rows(current_payments(base, store), "updated_at") == {(at,)}
    assert rows(spark.read.parquet(store.path("logs")), "created_at") == {(at,)}
