from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from boxoffice.operators import aggregates as agg
from boxoffice.operators import dml, outbox, settlement
from boxoffice.operators.aggregates import confirmed_attendees, tickets_per_payment
from boxoffice.sources import schemas
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
NOW = datetime(2024, 2, 1, 12)
D = Decimal


def hours(n, seconds=0):
    return NOW + timedelta(hours=n, seconds=seconds)


@pytest.fixture
def world(table):
    """Event e1 (owner u1) with three price tiers, e2 (owner u2) around the refund window."""
    def detail(i, price, show, event):
        return (i, show, D(price), 9, 5, f"tier {i}", T0, None, event)

    def payment(i, intent, amount, status, user, day=0):
        return (i, intent, D(amount), "usd", status, T0, T0 + timedelta(days=day), None, user)

    def ticket(i, d, p, u):
        return (i, f"{u}@x.com", T0, None, d, u, p)

    return {
        "users": table(
            schemas.USERS,
            *[(f"u{i}", "Ann", f"L{i}", f"u{i}@x.com", "h", T0, None) for i in range(1, 5)],
        ),
        "events": table(
            schemas.EVENTS,
            ("e1", "Rock", "x", None, T0, None, "u1"),
            ("e2", "Jazz", "x", None, T0, None, "u2"),
        ),
        "event_details": table(
            schemas.EVENT_DETAILS,
            detail("a", 10, hours(100), "e1"),
            detail("b", 10, hours(100), "e1"),
            detail("c", 25, hours(100), "e1"),
            detail("near", 10, hours(47), "e2"),
            detail("edge", 10, hours(48), "e2"),
            detail("over", 10, hours(48, 1), "e2"),
            detail("past", 10, hours(-49), "e2"),
            detail("gratis", 0, hours(99), "e2"),
        ),
        "payments": table(
            schemas.PAYMENTS,
            payment("p1", "pi1", 55, "succeeded", "u1"),
            payment("p2", "pi2", 0, "succeeded", "u2"),
            payment("p3", "pi3", 10, "refunded", "u2"),
            payment("p4", None, 10, "pending", "u3"),
            payment("p5", "pi5", 10, "succeeded", "u3"),
            payment("p6", "pi5", 10, "pending", "u4", day=1),
            payment("p7", "pi7", 40, "refund pending", "u2"),
            payment("p8", "pi8", 40, "succeeded", "u3"),
            payment("p9", "pi9", 40, "succeeded", "u4"),
        ),
        "reservations": table(
            schemas.RESERVATIONS,
            ticket("r1", "a", "p1", "u1"), ticket("r2", "b", "p1", "u1"),
            ticket("r3", "c", "p1", "u1"), ticket("r4", "c", "p1", "u1"),
            ticket("r5", "a", "p2", "u2"), ticket("r6", "a", "p3", "u2"),
            ticket("r7", "a", "p4", "u3"), ticket("r8", "a", "p5", "u3"),
            ticket("r9", "a", "p6", "u4"),
            ticket("s1", "near", "p7", "u2"), ticket("s2", "edge", "p7", "u2"),
            ticket("s3", "over", "p7", "u2"), ticket("s4", "past", "p7", "u2"),
            ticket("t1", "gratis", "p9", "u4"),
        ),
        "outcomes": table(
            schemas.OUTCOMES,
            *[
                (p, a, s, code, m, None, r, e, None, None, None)
                for p, a, s, code, m, r, e in [
                    ("p1", "refund", "succeeded", None, None, None, None),
                    ("p2", "refund", "failed", None, None, "expired", None),
                    ("p4", "cancel", "canceled", None, None, None, None),
                    ("p5", "refund", None, "charge_gone", "No such charge.", None, "gateway"),
                    ("p6", "cancel", None, None, "reset", None, "other"),
                    ("p7", "refund", "pending", None, None, None, None),
                ]
            ],
        ),
    }


def refunds(table, w, *asks):
    return settlement.customer_refunds(
        table("payment_id STRING, user_id STRING", *asks), w["payments"], w["reservations"],
        w["event_details"], w["events"], w["outcomes"], NOW,
    )


def test_customer_refund(table, world):
    got = refunds(table, world, ("p7", "u2"), ("p7", "u1"), ("p4", "u3"), ("p8", "u3"),
                  ("p9", "u4"), ("p2", "u2"), ("p5", "u3"), ("p1", "u1"))
    by = {(r.payment_id, r.user_id): r for r in got.summary.collect()}
    # More than 48 hours away in either direction; exactly 48 hours is not enough. The status
    # of the payment is not looked at.
    pending = by["p7", "u2"]
    assert (pending.outcome, pending.refunded_count, pending.refund_total, pending.new_status) == (
        "ok", 2, D("20.00"), "refund pending"
    )
    assert by["p7", "u1"].outcome == "not_found"
    assert (by["p4", "u3"].outcome, by["p4", "u3"].message.split("\n")[1:], by["p4", "u3"].error_count) == (
        "error", ["payment intent ID is missing"], 1
    )
    assert (by["p8", "u3"].outcome, by["p8", "u3"].message.split("\n")[1:]) == (
        "error", ["incomplete reservation details found"]
    )
    assert by["p9", "u4"].outcome == "no_amount"
    assert (by["p2", "u2"].outcome, by["p2", "u2"].new_status, by["p2", "u2"].message) == (
        "refund_failed", "refund_failed", "Refund failed: expired"
    )
    assert (by["p5", "u3"].outcome, by["p5", "u3"].new_status) == ("refund_rejected", "refund_failed")
    assert (by["p1", "u1"].new_status, by["p1", "u1"].message) == (
        "succeeded", "Refund succeeded immediately."
    )
    assert {r[0] for r in rows(got.lines.filter("payment_id = 'p7'"), "reservation_id")} == {
        "s3", "s4"
    }
    assert {r[0] for r in rows(got.lines.filter("payment_id = 'p9'"), "reservation_id")} == {"t1"}


def test_one_incomplete_row_fails_the_whole_payment(table, world):
    broken = table(schemas.RESERVATIONS, ("x", "x", T0, None, "missing", "u2", "p7"))
    world["reservations"] = world["reservations"].unionByName(broken)
    got = refunds(table, world, ("p7", "u2"))
    one = got.summary.first()
    assert (one.outcome, one.error_count) == ("error", 1)
    assert got.lines.count() == 0


def test_settled_refund_keeps_the_amount(table, world):
    done = refunds(table, world, ("p7", "u2"), ("p9", "u4"))
    new = settlement.settle_customer_refunds(
        done, world["payments"], world["reservations"], world["event_details"], NOW
    )
    got = {r.id: (r.amount, r.status, r.updated_at) for r in new["payments"].collect()}
    assert got["p7"] == (D("40.00"), "refund pending", NOW)
    assert got["p9"] == (D("40.00"), "succeeded", None)
    left = {r[0] for r in rows(new["reservations"], "id")}
    assert left & {"s1", "s2", "s3", "s4", "t1"} == {"s1", "s2"}
    stock = dict(rows(new["event_details"], "id", "tickets_remaining"))
    assert (stock["over"], stock["past"], stock["near"], stock["gratis"]) == (6, 6, 5, 6)


def event_plan(table, w, user="u1"):
    asks = table("event_id STRING, user_id STRING, user_email STRING", ("e1", user, "u1@x.com"))
    return asks, settlement.event_cancel_plan(
        asks, w["events"], w["event_details"], w["reservations"], w["payments"], w["outcomes"]
    )


def test_event_cancel(table, world):
    asks, plan = event_plan(table, world)
    got = rows(plan, "payment_id", "price", "refund_amount", "action", "outcome", "new_status",
               "notify")
    assert got == {
        # equal prices merge, another tier makes a row of its own
        ("p1", D("10.00"), D("20.00"), "refund", "refunded", "refunded", True),
        ("p1", D("25.00"), D("50.00"), "refund", "refunded", "refunded", True),
        # a free payment still makes an action; a failed refund leaves an empty status
        ("p2", D("10.00"), D("0.00"), "refund", "refund_failed", "", True),
        ("p4", D("10.00"), D("10.00"), "cancel", "cancelled", "cancelled", True),
        ("p5", D("10.00"), D("10.00"), "refund", "gateway_error", None, False),
        ("p6", D("10.00"), D("10.00"), "cancel", "error", "", True),
    }
    failed = rows(plan.filter("failed_action is not null"), "payment_id", "failed_action",
                  "failed_code", "failed_message")
    assert failed == {("p5", "stripe refund request", "charge_gone", "No such charge.")}
    logs = rows(settlement.cancel_logs(plan, asks, "event_id", NOW), "payment_id", "status",
                "description", "payment_intent_id", "user_email")
    assert ("p2", "failed", "expired", "pi2", "u1@x.com") in logs
    assert ("p4", "cancelled", "event deleted", "", "u1@x.com") in logs
    assert ("p5", "charge_gone", "No such charge.", "pi5", "u1@x.com") in logs
    assert ("p6", "", None, "pi5", "u1@x.com") in logs
    new = dml.update_payment(world["payments"], settlement.cancel_updates(plan), NOW)
    by = {r.id: (r.amount, r.status) for r in new.collect()}
    assert by["p1"] == (D("50.00"), "refunded")
    assert by["p2"] == (D("0.00"), "")
    assert by["p5"] == (D("10.00"), "succeeded")
    mails = outbox.event_cancelled_mails(plan, outbox.payers_of(world["payments"], world["users"], plan))
    assert rows(mails, "payment_id", "recipient") == {
        (p, f"Ann L{u} <u{u}@x.com>") for p, u in [("p1", 1), ("p2", 2), ("p4", 3), ("p6", 4)]
    }


def test_only_the_owner_cancels(table, world):
    assert event_plan(table, world, "u2")[1].count() == 0


def test_detail_cancel(table, world):
    asks = table("event_detail_id STRING, user_id STRING", ("a", "u1"), ("gratis", "u2"),
                 ("c", "u2"))
    plan = settlement.detail_cancel_plan(
        asks, world["events"], world["event_details"], world["reservations"], world["payments"],
        world["users"], world["outcomes"],
    )
    got = rows(plan, "event_detail_id", "payment_id", "action", "refund_amount", "outcome",
               "update_applies", "notify")
    assert got == {
        # the owner is the payer here, so the update hits
        ("a", "p1", "refund", D("10.00"), "refunded", True, True),
        ("a", "p2", "notice", D("0.00"), "free", False, True),
        # p4 has no intent; of p5 and p6 the later one stands for their common intent
        ("a", "p6", "cancel", D("10.00"), "error", False, True),
        ("gratis", "p9", "notice", D("0.00"), "free", False, True),
    }
    mail = outbox.detail_cancelled_mails(
        plan, outbox.payers_of(world["payments"], world["users"], plan), "- T"
    ).filter("payment_id = 'p1'").first()
    assert mail.subject == "Your payment for Rock was refunded/cancelled"
    assert mail.body.startswith("Hi Ann L1,\n\nThe event reservation you've booked: Rock - tier a,")
    assert mail.body.endswith("\n\n- T")


def test_attendees_and_counts(table, world):
    keys = table("event_id STRING", ("e1",), ("e2",))
    got = confirmed_attendees(keys, world["event_details"], world["reservations"],
                              world["payments"], world["users"])
    assert rows(got, "event_id", "user_id") == {
        ("e1", "u1"), ("e1", "u2"), ("e1", "u3"), ("e2", "u4")
    }
    counts = tickets_per_payment(world["reservations"])
    assert ("p1", "c", 2) in rows(counts, "payment_id", "event_detail_id", "tickets")


def test_updated_event_mail_shows_the_organizer_only_if_given(table):
    people = table("event_id STRING, user_id STRING, full_name STRING, email STRING",
                   ("e1", "u", "Ann Lee", "a@x.com"), ("e2", "u", "Ann Lee", "a@x.com"))
    news = table("id STRING, title STRING, description STRING, organizer STRING",
                 ("e1", "T", "D", "Org"), ("e2", "T", "D", "  "))
    got = {r.event_id: r.body for r in outbox.event_updated_mails(news, people, "- T").collect()}
    assert got["e1"].endswith("Title: T\nDescription: D\nOrganizer: Org\r\n\n- T")
    assert got["e2"].endswith("Title: T\nDescription: D\n\n- T")


def test_cancelled_events_go_with_their_tickets(table, world):
    asks = table("event_id STRING, user_id STRING, user_email STRING",
                 ("e1", "u1", "u1@x.com"), ("e2", "u1", "u1@x.com"))
    new = settlement.cancel_events(asks, world, world["outcomes"], NOW)
    assert rows(new["deletions"], "id", "deleted") == {("e1", 1), ("e2", 0)}
    assert rows(new["events"], "id") == {("e2",)}
    assert {r[0] for r in rows(new["reservations"], "id")} == {"s1", "s2", "s3", "s4", "t1"}
    by = {r.id: (r.amount, r.status) for r in new["payments"].collect()}
    assert by["p4"] == (D("10.00"), "cancelled")
    assert by["p3"] == (D("10.00"), "refunded")
    assert new["payment_logs"].count() == new["plan"].count() == 6


def test_cancelled_ticket_type_settles_for_the_owner_only(table, world):
    schema = "event_detail_id STRING, event_id STRING, user_id STRING, user_email STRING"
    asks = table(schema, ("a", "e1", "u1", "u1@x.com"), ("edge", "e2", "u1", "u1@x.com"))
    new = settlement.cancel_event_details(asks, world, world["outcomes"], NOW)
    by = {r.id: (r.amount, r.status) for r in new["payments"].collect()}
    assert by["p1"] == (D("10.00"), "refunded")  # the owner paid it
    assert by["p6"] == (D("10.00"), "pending")   # someone else did
    # the delete does not ask who the owner is
    left = {r[0] for r in rows(new["event_details"], "id")}
    assert "a" not in left and "edge" not in left
    assert new["payment_logs"].count() == 2


def test_one_answer_per_ticket_price(table, world):
    """Two prices of one payment: one refund goes through, the other fails."""
    more = table(
        schemas.OUTCOMES,
        ("p1", "refund", "failed", None, None, None, "expired", None, None, None, D("25.00")),
        ("p1", "refund", "failed", None, None, None, "never asked", None, None, None, D("99.00")),
    )
    w = dict(world, outcomes=world["outcomes"].unionByName(more))
    plan = event_plan(table, w)[1].filter("payment_id = 'p1'")
    prices = sorted((r.price, r.outcome, r.log_description) for r in plan.collect())
    assert len(prices) > 1
    assert {o for p, o, _ in prices if p == D("25.00")} <= {"refund_failed"}
    assert all((o == "refund_failed") == (p == D("25.00")) for p, o, _ in prices)


def test_totals_lie_by_payment_and_sum_up_numbers(spark, capsys):
    """Totals of events are dealt out by payment alone; no aggregate of reservations carries the texts of a ticket type."""
    names = ("events", "event_details", "reservations", "payments", "users")
    events, details, booked, paid, users = (spark.createDataFrame([], getattr(schemas, n.upper())) for n in names)
    agg.event_refund_totals(spark.createDataFrame([], "event_id string, user_id string"), events, details, booked, paid).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(payment_id" in plan.replace("#", " #").replace("payment_id #", "payment_id") and "REPARTITION_BY_COL" in plan
    agg.detail_refund_totals(spark.createDataFrame([], "event_detail_id string, user_id string"), events, details, booked, paid, users).explain()
    plan = capsys.readouterr().out
    sums = [line for line in plan.splitlines() if "HashAggregate(keys=[payment_id" in line]
    assert sums and not any("title" in line for line in sums)


def test_refunds_are_written_without_the_reservations_texts(table, world, monkeypatch, capsys):
    """Verdicts, stock and payments come from numbers; ids of reservations are dealt out by ticket type and by payment alone."""
    written = {}
    plain = settlement.materialize
    monkeypatch.setattr(settlement, "materialize", lambda df, label: written.setdefault(label, df) and plain(df, label))
    done = refunds(table, world, ("p7", "u2"), ("p1", "u1"))
    new = settlement.settle_customer_refunds(done, world["payments"], world["reservations"], world["event_details"], NOW)
    assert "reservation_id" not in written["refund-lines"].columns and written["refund-lines"].count() == 6
    assert {r[0] for r in rows(new["reservations"], "id")} == {"r5", "r6", "r7", "r8", "r9", "s1", "s2", "t1"}
    done.lines.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done.lines.explain("formatted")
    finally:
        done.lines.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    steps = capsys.readouterr().out.split("\n\n")
    exchanges = [step for step in steps if ") Exchange" in step.split("\n")[0] and "reservation_id" in step]
    assert len(exchanges) == 2
