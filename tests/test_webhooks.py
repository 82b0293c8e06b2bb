import json
import random
from pathlib import Path
from types import SimpleNamespace
from datetime import datetime
from decimal import Decimal

import pytest

from boxoffice.functions.scale import shared_dir
from boxoffice.plans import queries
from boxoffice.operators.webhook_fold import apply_payment_changes, fold_webhooks, touchable
from boxoffice.operators import outbox
from boxoffice.operators.aggregates import nest_tickets
from boxoffice.sources import schemas
from boxoffice.sources.webhooks import BATCH_SPAN, number_messages, parse_webhooks, read_webhook_files
from boxoffice.streaming.webhook_stream import (
    WebhookStore,
    apply_webhook_stream,
    compact,
    current_payments,
)
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
NOW = datetime(2024, 2, 1)
D = Decimal
PAYMENTS = schemas.PAYMENTS.replace("id STRING, payment_intent_id", "id BIGINT, payment_intent_id")
INTENT = ("payment_intent.succeeded", "payment_intent.payment_failed",
          "payment_intent.requires_action")
STATUS = dict(zip(INTENT, ("succeeded", "payment_failed", "requires_action")))


def intent(kind, payment, intent_id, cents=1000, error=None, method="pm"):
    o = {"id": intent_id, "amount": cents, "payment_method": method,
         "metadata": {} if payment is None else {"payment_id": str(payment)}}
    if error is not None:
        o["last_payment_error"] = {"message": error}
    return {"type": kind, "data": {"object": o}}


def refunded(intent_id, cents=500):
    return {"type": "charge.refunded", "data": {"object": {
        "id": "ch", "payment_intent": intent_id, "amount": 9999, "amount_refunded": cents}}}


def refund_failed(intent_id, reason=None, cents=700):
    return {"type": "refund.failed", "data": {"object": {
        "id": "re", "payment_intent": intent_id, "amount": cents, "failure_reason": reason}}}


def payment(i, intent_id, status="pending", amount=10, day=1, user="u1"):
    return (i, intent_id, D(amount), "usd", status, datetime(2024, 1, 1, 0, 15),
            datetime(2024, 1, day), None, user)


@pytest.fixture
def users(table):
    return table(schemas.USERS, ("u1", "Ann", "Lee", "ann@x.com", "h", T0, None))


def fold(table, users, payments, events, split_rows=10**6, dedupe=False, start=0):
    raw = table("seq BIGINT, value STRING",
                *[(start + i, e if isinstance(e, str) else json.dumps(e))
                  for i, e in enumerate(events)])
    return fold_webhooks(parse_webhooks(raw), table(PAYMENTS, *payments), users, NOW,
                         dedupe, split_rows)


def test_guard_of_charge_refunded(table, users):
    payments = [payment(1, "a", "refund pending"), payment(2, "b", "succeeded"),
                payment(3, "c", "refund pending"), payment(4, "d", "refund pending")]
    got = fold(table, users, payments, [
        refunded("a"), refunded("a"),                       # the second one is ignored
        refunded("b"),                                      # not waiting for a refund
        intent(INTENT[0], 3, "c", 1234), refunded("c"),     # an intent event came first
        refunded("d"), intent(INTENT[1], 4, "d", 4321),     # overwrites even "refunded"
    ])
    assert rows(got.payments, "id", "status", "amount", "payment_intent_id", "updated_at") == {
        (1, "refunded", D("0.00"), "a", NOW), (3, "succeeded", D("12.34"), "c", NOW),
        (4, "payment_failed", D("43.21"), "d", NOW),
    }
    assert rows(got.quarantine, "seq", "reason") == {
        (1, "not_refund_pending"), (2, "not_refund_pending"), (4, "not_refund_pending")
    }
    assert rows(got.logs, "payment_id", "status", "description", "amount") == {
        (1, "succeeded", "Refund confirmed by Stripe webhook. Amount set to 0.00.", D("5.00")),
        (3, "succeeded", "Payment succeeded.", D("12.34")),
        (4, "succeeded", "Refund confirmed by Stripe webhook. Amount set to 0.00.", D("5.00")),
        (4, "payment_failed", "Payment failed.", D("43.21")),
    }


def test_logs_and_texts(table, users):
    payments = [payment(1, "a"), payment(2, "b", user="gone")]
    got = fold(table, users, payments, [
        intent(INTENT[1], 1, "a", error="No funds."),
        intent(INTENT[1], 1, "a", error=""),
        intent(INTENT[2], 1, "a"),
        refund_failed("a"),
        refund_failed("a", "expired_card"),
        refund_failed("b", "lost"),
        intent(INTENT[0], 2, "b"),
    ])
    assert rows(got.logs, "status", "description", "user_email", "payment_method_id") == {
        ("payment_failed", "No funds.", "ann@x.com", "pm"),
        ("payment_failed", None, "ann@x.com", "pm"),
        ("requires_action",
         "Payment requires action. Please complete the action before 2024-01-01 00:15:00",
         "ann@x.com", "pm"),
        ("failed", "Refund failed: Unknown reason", "ann@x.com", None),
        ("failed", "Refund failed: expired_card", "ann@x.com", None),
        ("failed", "Refund failed: lost", "unknown@example.com", None),
    }
    # an intent event of a payment without a user is dropped
    assert rows(got.quarantine, "seq", "reason") == {(6, "unknown_user")}


def test_dropped_events(table, users):
    got = fold(table, users, [payment(1, "a")], [
        json.dumps(intent(INTENT[0], 1, "a")) + " " * 65536,
        '{"type": "refund',
        {"type": "customer.created", "data": {"object": {"id": "c"}}},
        intent(INTENT[0], None, "a"),
        intent(INTENT[0], "not-an-id", "a"),
        intent(INTENT[0], 99, "a"),
        refunded(None),
        refunded(""),
        refunded("zzz"),
    ])
    assert rows(got.quarantine, "seq", "reason") == {
        (0, "oversize"), (1, "bad_json"), (2, "unhandled_type"), (3, "missing_payment_id"),
        (4, "bad_payment_id"), (5, "unknown_payment"), (6, "missing_intent"),
        (7, "missing_intent"), (8, "unknown_intent"),
    }
    assert got.payments.count() == got.logs.count() == 0


def test_body_of_exactly_the_cap_is_read(table, users):
    body = json.dumps(intent(INTENT[0], 1, "a"))
    got = fold(table, users, [payment(1, "a")], [body + " " * (65536 - len(body))])
    assert got.logs.count() == 1


def test_intent_id_is_looked_up_as_it_stood(table, users):
    payments = [payment(1, "a"), payment(2, None), payment(3, "a", day=2)]
    got = fold(table, users, payments, [
        refund_failed("a"),               # 1 and 3 hold it: the older payment
        intent(INTENT[0], 1, "new"),
        refund_failed("a"),               # only 3 holds it now
        refund_failed("new"),             # 1
        intent(INTENT[0], 2, "a"),        # 2 takes it over too, and is older than 3
        refund_failed("a"),
        intent(INTENT[0], 2, ""),         # 2 has none any more
        refund_failed("a"),
    ])
    by = {r.seq: r.payment_id for r in got.applied.filter("type = 'refund.failed'").collect()}
    assert by == {0: 1, 2: 3, 3: 1, 5: 2, 7: 3}
    assert rows(got.payments, "id", "payment_intent_id") == {(1, "new"), (2, None), (3, "a")}


def test_dedupe_is_a_choice(table, users):
    events = [intent(INTENT[0], 1, "a")] * 3
    assert fold(table, users, [payment(1, "a")], events).logs.count() == 3
    assert fold(table, users, [payment(1, "a")], events, dedupe=True).logs.count() == 1


def loop(payments, events):
    """The plain rule: one event after the other against the table."""
    table = {p[0]: dict(id=p[0], intent=p[1], amount=p[2], status=p[4], created=p[6])
             for p in payments}
    logs, dropped = [], {}
    for seq, e in enumerate(events):
        o, kind = e["data"]["object"], e["type"]
        if kind in INTENT:
            p = table.get(int(o["metadata"]["payment_id"]))
            if p is None:
                dropped[seq] = "unknown_payment"
                continue
            p.update(status=STATUS[kind], amount=D(o["amount"]) / 100, intent=o["id"] or None)
            logs.append((seq, p["id"]))
            continue
        holders = [p for p in table.values() if p["intent"] == o["payment_intent"]]
        if not holders:
            dropped[seq] = "unknown_intent"
            continue
        p = min(holders, key=lambda h: (h["created"], h["id"]))
        if kind == "charge.refunded":
            if p["status"] != "refund pending":
                dropped[seq] = "not_refund_pending"
                continue
            p.update(status="refunded", amount=D("0.00"))
        else:
            p.update(status="refund_failed")
        logs.append((seq, p["id"]))
    return {(p["id"], p["status"], p["amount"], p["intent"]) for p in table.values()}, logs, dropped


def traffic(seed, n_payments=25, n_events=250):
    rng = random.Random(seed)
    ids = ["x", "y", "z", *[f"i{i}" for i in range(n_payments)]]
    payments = [
        payment(i, rng.choice([None, "x", f"i{i}"]),
                rng.choice(["refund pending", "succeeded", "pending"]), rng.randrange(1, 90),
                rng.randrange(1, 28))
        for i in range(n_payments)
    ]
    events = []
    for _ in range(n_events):
        i = 0 if rng.random() < 0.4 else rng.randrange(n_payments + 1)
        if rng.random() < 0.5:
            picked = rng.choice([f"i{i}", "x", "y", f"i{i}"])
            events.append(intent(rng.choice(INTENT), i, picked, rng.randrange(1, 9999)))
        else:
            picked = rng.choice(ids)
            events.append(rng.choice([refunded(picked), refund_failed(picked)]))
    return payments, events


@pytest.mark.parametrize(("seed", "split_rows"), [(1, 10**6), (2, 10**6), (3, 20), (4, 20)])
def test_fold_equals_a_loop(table, users, seed, split_rows):
    payments, events = traffic(seed)
    want, want_logs, want_dropped = loop(payments, events)
    got = fold(table, users, payments, events, split_rows)
    whole = apply_payment_changes(table(PAYMENTS, *payments), got.payments)
    assert rows(whole, "id", "status", "amount", "payment_intent_id") == want
    assert rows(got.applied, "seq", "payment_id") == set(want_logs)
    assert rows(got.quarantine, "seq", "reason") == set(want_dropped.items())
    assert got.logs.count() == len(want_logs)


def test_stream_equals_one_batch(spark, table, users, tmp_path):
    payments, events = traffic(9, 12, 90)
    want, want_logs, want_dropped = loop(payments, events)
    base, inbox = table(PAYMENTS, *payments), tmp_path / "in"
    inbox.mkdir()
    store = WebhookStore(str(tmp_path / "out"))
    for part in range(3):
        lines = [json.dumps({"seq": s, "channel": "payment", "value": json.dumps(events[s])})
                 for s in range(part * 30, part * 30 + 30)]
        (inbox / f"{part}.json").write_text("\n".join(lines))
        raw = read_webhook_files(spark, str(inbox))
        job = apply_webhook_stream(raw, base, users, store, str(tmp_path / "ck"), NOW)
        job.trigger(availableNow=True).start().awaitTermination()
    assert rows(current_payments(base, store), "id", "status", "amount", "payment_intent_id") == want
    logs = store.read(spark, "logs", schemas.PAYMENT_LOGS.replace("payment_id STRING", "payment_id BIGINT"))
    assert logs.count() == len(want_logs)
    bad = store.read(spark, "quarantine", "seq BIGINT, type STRING, reason STRING")
    assert rows(bad, "seq", "reason") == set(want_dropped.items())
    assert rows(logs, "batch") == {(0,), (1,), (2,)}
    # A base that already holds the first two batches gives the same table.
    current_payments(base, store, 2).write.parquet(str(tmp_path / "base2"))
    newer = spark.read.schema(base.schema).parquet(str(tmp_path / "base2"))
    again = current_payments(newer, WebhookStore(store.root, first_batch=2))
    assert rows(again, "id", "status", "amount", "payment_intent_id") == want


def test_stream_with_a_new_base_in_between(spark, table, users, tmp_path):
    payments, events = traffic(10, 12, 90)
    want, _, _ = loop(payments, events)
    base, inbox = table(PAYMENTS, *payments), tmp_path / "in"
    inbox.mkdir()
    store = WebhookStore(str(tmp_path / "out"))
    before = set(Path(shared_dir(spark).removeprefix("file:")).iterdir())
    for part in range(3):
        lines = [json.dumps({"seq": s, "channel": "payment", "value": json.dumps(events[s])})
                 for s in range(part * 30, part * 30 + 30)]
        (inbox / f"{part}.json").write_text("\n".join(lines))
        raw = read_webhook_files(spark, str(inbox))
        job = apply_webhook_stream(raw, base, users, store, str(tmp_path / "ck"), NOW)
        job.trigger(availableNow=True).start().awaitTermination()
        if part == 1:
            store = compact(base, store, str(tmp_path / "base"), 2)
            base = spark.read.schema(base.schema).parquet(str(tmp_path / "base"))
    assert rows(current_payments(base, store), "id", "status", "amount", "payment_intent_id") == want
    # The batches' own tables are gone.
    assert set(Path(shared_dir(spark).removeprefix("file:")).iterdir()) == before


def test_messages_of_two_topics_are_numbered_in_arrival_order(spark):
    messages = [(datetime(2024, 1, 1, 0, 0, i // 3), "ab"[i % 2], i % 2, i // 2, f"m{i}") for i in range(40)]
    order = sorted(messages, key=lambda m: m[:4])
    df = spark.createDataFrame(messages, "timestamp TIMESTAMP, topic STRING, partition INT, offset LONG, value STRING")
    got = {r.seq: r.value for r in number_messages(df.repartition(5), 3).collect()}
    assert [got[3 * BATCH_SPAN + k] for k in range(40)] == [m[4] for m in order]
    assert number_messages(df.limit(0), 1).count() == 0


def test_a_batch_reads_two_columns_to_find_its_payments(spark, table, tmp_path):
    table(PAYMENTS, payment(1, "a")).write.parquet(str(tmp_path / "p"))
    base = spark.read.parquet(str(tmp_path / "p"))
    raw = table("seq BIGINT, value STRING", (0, json.dumps(refunded("a"))))
    plan = touchable(parse_webhooks(raw), base)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint,payment_intent_id:string>" in plan


def test_mails(table, users):
    payments = table(PAYMENTS, payment(1, "a"), payment(2, "b"))
    reservations = table(
        schemas.RESERVATIONS.replace("payment_id STRING", "payment_id BIGINT"),
        ("r1", "e", T0, None, "d2", "u1", 1), ("r2", "e", T0, None, "d1", "u1", 1),
        ("r3", "e", T0, None, "d1", "u1", 1), ("r4", "e", T0, None, "d1", "other", 2),
    )
    details = table("id STRING, title STRING, ticket_description STRING, show_date TIMESTAMP_NTZ",
                    ("d1", "Rock", "floor", T0), ("d2", "Rock", "lounge", T0))
    failed = table("mail_key INT, payment_id BIGINT, error_message STRING",
                   (1, 1, "No funds."), (2, 2, "No funds."))
    payers = outbox.payers_of(payments, users, failed)
    lines = outbox.ticket_lines(reservations, payments, details, failed)
    mails = outbox.failure_mails(failed, payers, lines, "- T").collect()
    # payment 2 has no reservation of its payer: no mail
    assert [m.mail_key for m in mails] == [1]
    assert mails[0].recipient == "Ann Lee <ann@x.com>"
    assert mails[0].body == (
        "Hi Ann Lee,\n\nYour payment failed with the following issue: No funds.\n\n"
        "Reservation/s attached with the payment:\n"
        "Rock - floor - 2024-01-01 00:00:00 +0000 +0000\n"
        "Rock - lounge - 2024-01-01 00:00:00 +0000 +0000\n\n\n- T"
    )
    assert rows(outbox.mail_lines(reservations, payments, details, failed), "payment_id", "line") == {
        (1, "Rock - floor - 2024-01-01 00:00:00 +0000 +0000"),
        (1, "Rock - lounge - 2024-01-01 00:00:00 +0000 +0000"),
    }


@pytest.mark.parametrize("n", [1001, 5000])
def test_long_lists_stay_whole_and_in_order(spark, table, users, n):
    payments = table(PAYMENTS, payment(1, "a"))
    ids = spark.range(n).selectExpr("lpad(id, 5, '0') as id")
    details = ids.selectExpr("id", "'Rock' as title", "concat('t', id) as ticket_description",
                             "timestamp_ntz'2024-01-01 00:00:00' as show_date")
    reservations = ids.selectExpr("1L as payment_id", "'u1' as user_id", "id as event_detail_id")
    wanted = table("mail_key INT, payment_id BIGINT", (1, 1))
    payers = outbox.payers_of(payments, users, wanted)
    lines = outbox.ticket_lines(reservations, payments, details, wanted)
    (mail,) = outbox.confirmation_mails(wanted, payers, lines).collect()
    told = [x.split(" - ")[1] for x in mail.body.split("\n") if x.startswith("Rock")]
    assert told == [f"t{i:05}" for i in range(n)]
    flat = details.selectExpr("'e' as event_id", "id as event_detail_id", "show_date", "ticket_description",
                              "1 as price", "2 as number_of_tickets", "2 as tickets_remaining")
    (event,) = nest_tickets(flat).collect()
    assert [t.id for t in event.tickets] == [f"{i:05}" for i in range(n)]


def test_amounts_beyond_the_money_type(table, users):
    payments = [payment(1, "a", "refund pending"), payment(2, "b", "refund pending")]
    events = [intent(INTENT[0], 1, "a", cents=10**12), refunded("b", cents=10**12), intent(INTENT[0], 1, "a")]
    got = fold(table, users, payments, events)
    assert rows(got.quarantine, "seq", "reason") == {(0, "bad_amount"), (1, "bad_log_amount")}
    assert rows(got.payments, "id", "status") == {(1, "succeeded"), (2, "refunded")}
    assert rows(got.logs, "payment_id") == {(1,)}


def test_mails_read_the_applied_events_from_one_table(spark, monkeypatch):
    """The fold is not run again for the payers and the lines of a mail."""
    applied = spark.createDataFrame(
        [(1, "payment_intent.payment_failed", 5, "no"), (2, "refund.failed", 5, "no")], "seq long, type string, payment_id long, error_message string"
    )
    monkeypatch.setattr(queries, "_fold", lambda d: SimpleNamespace(applied=applied))
    tables = SimpleNamespace(
        events=spark.createDataFrame([(1, "Rock")], "id long, title string"),
        event_details=spark.createDataFrame([(3, 1, "floor", None)], "id long, event_id long, ticket_description string, show_date timestamp_ntz"),
        reservations=spark.createDataFrame([(5, 7, 3)], "payment_id long, user_id long, event_detail_id long"),
        payments=spark.createDataFrame([(5, 7)], "id long, user_id long"),
        users=spark.createDataFrame([(7, "A", "B", "a@b.c")], "id long, firstname string, lastname string, email string"),
    )
    mails, payers, lines = queries._applied(tables, "payment_intent.payment_failed")
    assert [tuple(r) for r in mails.collect()] == [(1, 5, "no")]
    assert (payers.count(), lines.count()) == (1, 1)
    assert all(any("/applied-" in f for f in df.inputFiles()) for df in (mails, payers, lines))
