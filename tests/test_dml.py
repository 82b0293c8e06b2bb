"""Updates and deletes. Short ids; every table has its full schema."""

import random
from datetime import datetime
from decimal import Decimal

import pytest

from boxoffice.operators import dml
from boxoffice.operators.inserts import check_registrations, create_event_details, create_payments
from boxoffice.sources import intake, schemas
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
NOW = datetime(2024, 2, 1)
D = Decimal


@pytest.fixture
def tables(table):
    return {
        "users": table(
            schemas.USERS,
            ("u1", "Ann", "Lee", "ann@x.com", "h", T0, None),
            ("u2", "Bob", "Ray", "bob@x.com", "h", T0, None),
        ),
        "events": table(
            schemas.EVENTS,
            ("e1", "Rock", "loud", "Org", T0, None, "u1"),
            ("e2", "Jazz", "calm", None, T0, None, "u2"),
        ),
        "event_details": table(
            schemas.EVENT_DETAILS,
            ("d1", T0, D(10), 5, 3, "a", T0, None, "e1"),
            ("d2", T0, D(20), 5, 1, "b", T0, None, "e1"),
            ("d3", T0, D(30), 5, 0, "c", T0, None, "e2"),
        ),
        "payments": table(
            schemas.PAYMENTS,
            ("p1", "pi1", D(20), "usd", "succeeded", T0, T0, None, "u1"),
            ("p2", None, D(30), "usd", "pending", T0, T0, None, "u2"),
            ("p3", "pi3", D(5), "usd", "pending", T0, T0, None, "u2"),
        ),
        "reservations": table(
            schemas.RESERVATIONS,
            ("r1", "a@x.com", T0, None, "d1", "u1", "p1"),
            ("r2", "a@x.com", T0, None, "d1", "u1", "p1"),
            ("r3", "b@x.com", T0, None, "d3", "u2", "p2"),
        ),
    }


def test_update_event_needs_the_owner_and_last_wins(table, tables):
    asks = table(
        "seq INT, id STRING, user_id STRING, title STRING, description STRING, organizer STRING",
        (1, "e1", "u1", "first", "x", "o"),
        (2, "e1", "u1", "second", "y", ""),
        (3, "e1", "u2", "not the owner", "y", "o"),
        (4, "e9", "u1", "unknown", "y", "o"),
    )
    got = rows(dml.update_event(tables["events"], asks, NOW), "id", "title", "organizer",
               "updated_at", "updated")
    assert got == {("e1", "second", None, NOW, True), ("e2", "Jazz", None, None, False)}


def test_update_event_detail_keeps_tickets_remaining(table, tables):
    asks = table(
        "seq INT, id STRING, event_id STRING, show_date STRING, price DECIMAL(10,2), "
        "number_of_tickets INT, ticket_description STRING",
        (1, "d1", "e1", "2025-01-02 10:00", D(9), 100, "new"),
        (2, "d2", "e2", "2025-01-02 10:00", D(9), 100, "wrong event"),
        (3, "d3", "e2", "2025-02-30 10:00", D(9), 100, "bad date"),
    )
    got = rows(dml.update_event_detail(tables["event_details"], asks, NOW), "id",
               "number_of_tickets", "tickets_remaining", "ticket_description", "updated_at")
    assert got == {("d1", 100, 3, "new", NOW), ("d2", 5, 1, "b", None), ("d3", 5, 0, "c", None)}


def test_update_payment_and_email_need_the_user(table, tables):
    asks = table(
        "seq INT, id STRING, user_id STRING, amount DECIMAL(10,2), status STRING, "
        "payment_intent_id STRING",
        (1, "p1", "u1", D(7), "refunded", None),
        (2, "p2", "u1", D(7), "refunded", None),
    )
    got = rows(dml.update_payment(tables["payments"], asks, NOW), "id", "amount", "status",
               "payment_intent_id")
    assert got == {
        ("p1", D("7.00"), "refunded", None), ("p2", D("30.00"), "pending", None),
        ("p3", D("5.00"), "pending", "pi3"),
    }
    mails = table("seq INT, id STRING, user_id STRING, email STRING",
                  (1, "r1", "u1", "n@x.com"), (2, "r3", "u1", "n@x.com"))
    got = rows(dml.update_reservation_email(tables["reservations"], mails, NOW), "id", "email")
    assert got == {("r1", "n@x.com"), ("r2", "a@x.com"), ("r3", "b@x.com")}


@pytest.mark.parametrize("split_rows", [1_000_000, 40])
def test_reserve_single_against_a_loop(spark, table, split_rows):
    rng = random.Random(3)
    asks = [(i, "hot" if i % 3 else rng.choice(["a", "b", "gone"])) for i in range(300)]
    rng.shuffle(asks)
    details = table(
        schemas.EVENT_DETAILS,
        *[(k, T0, D(1), 99, n, "t", T0, None, "e") for k, n in [("hot", 50), ("a", 0), ("b", 500)]],
    )
    left, want = {"hot": 50, "a": 0, "b": 500}, set()
    for n, d in sorted(asks):
        ok = left.get(d, 0) > 0
        if ok:
            left[d] -= 1
        want.add((n, d, ok))
    df = spark.createDataFrame(asks, "n INT, event_detail_id STRING")
    done = dml.reserve_tickets(df, details, ["n"], split_rows)
    assert rows(done, "n", "event_detail_id", "reserved") == want
    taken = done.filter("reserved").selectExpr("event_detail_id", "1 as tickets")
    assert rows(dml.take_tickets(details, taken), "id", "tickets_remaining") == set(left.items())


def test_restore_and_delete(table, tables):
    asks = table(
        "seq INT, payment_id STRING, user_id STRING",
        (1, "p1", "u2"),  # not the payer: tickets come back, nothing is deleted
        (2, "p1", "u1"),  # the payer: tickets come back again, the payment goes
        (3, "p1", "u1"),  # nothing left
        (4, "p3", "u2"),  # no reservations: the payment stays
        (5, "p2", "u1"),  # not the payer
    )
    new = dml.restore_and_delete_payments(
        asks, tables["payments"], tables["reservations"], tables["event_details"]
    )
    assert rows(new["event_details"], "id", "tickets_remaining", "updated_at") == {
        ("d1", 3 + 2 + 2, None), ("d2", 1, None), ("d3", 0 + 1, None)
    }
    assert rows(new["payments"], "id") == {("p2",), ("p3",)}
    assert rows(new["reservations"], "id") == {("r3",)}


def test_refund_and_restore_are_independent(table, tables):
    schema = ("event_detail_id STRING, amount DECIMAL(10,2), payment_id STRING, user_id STRING, "
              "reservation_id STRING")
    asks = table(
        schema,
        ("d1", D(10), "p1", "u1", "r1"),
        ("d1", D(10), "p1", "u2", "r2"),  # payment does not match: ticket back, row stays
        ("d9", D(10), "p2", "u2", "r3"),  # unknown type: amount off, row stays
    )
    new = dml.refund_and_restore(
        asks, tables["payments"], tables["reservations"], tables["event_details"]
    )
    assert rows(new["event_details"], "id", "tickets_remaining") == {("d1", 5), ("d2", 1), ("d3", 0)}
    assert rows(new["payments"], "id", "amount", "updated_at") == {
        ("p1", D("10.00"), None), ("p2", D("20.00"), None), ("p3", D("5.00"), None)
    }
    assert rows(new["reservations"], "id") == {("r2",), ("r3",)}


def test_delete_event_cascades_and_counts(table, tables):
    asks = table("id STRING, user_id STRING", ("e1", "u1"), ("e2", "u1"), ("e9", "u1"))
    new = dml.delete_events(asks, tables)
    assert rows(new["deletions"], "id", "deleted") == {("e1", 1), ("e2", 0), ("e9", 0)}
    assert rows(new["events"], "id") == {("e2",)}
    assert rows(new["event_details"], "id") == {("d3",)}
    assert rows(new["reservations"], "id") == {("r3",)}
    assert new["payments"].count() == 3


def test_delete_detail_needs_its_event(table, tables):
    asks = table("id STRING, event_id STRING", ("d1", "e1"), ("d3", "e1"))
    new = dml.delete_event_details(asks, tables)
    assert rows(new["event_details"], "id") == {("d2",), ("d3",)}
    assert rows(new["reservations"], "id") == {("r3",)}


def test_delete_user_reaches_reservations_on_every_way(table, tables):
    new = dml.cascade_delete(tables, users=table("id STRING", ("u2",)))
    assert rows(new["events"], "id") == {("e1",)}
    assert rows(new["event_details"], "id") == {("d1",), ("d2",)}
    assert rows(new["payments"], "id") == {("p1",)}
    assert rows(new["reservations"], "id") == {("r1",), ("r2",)}


# --- intake and inserts ---------------------------------------------------------------


def test_registration_cases(table, tables):
    body = '{{"firstname": "{}", "lastname": "{}", "email": "{}", "password": "{}"}}'
    bodies = table(
        "seq INT, body STRING",
        (1, body.format("Arthur", "Morgan", "arthur.morgan@test.com", "GoodManArthur36!")),
        (2, body.format("A", "M", "weak@test.com", "weak")),
        (3, body.format("A", "M", "ann@x.com", "Password12345!")),
        (4, body.format("A", "M", "invalid@testcom", "weak")),
        (5, body.format("B", "M", "arthur.morgan@test.com", "Password12345!")),
        (6, '{"firstname": "A"'),
        (7, '{"firstname": "A", "lastname": "B", "email": "c@x.com"}'),
        (8, body.format("", "M", "d@x.com", "Password12345!")),
    )
    got = intake.registrations(bodies)
    assert rows(got.rejects, "seq") == {(6,), (7,), (8,)}
    checked = check_registrations(got.rows, tables["users"])
    assert "password" not in checked.columns
    assert rows(checked, "seq", "outcome") == {
        (1, "accepted"), (2, "weak_password"), (3, "email_taken"), (4, "invalid_email"),
        (5, "email_taken"),
    }


def test_event_intake_keeps_good_tickets(table):
    bodies = table(
        "request_id INT, user_id STRING, body STRING",
        (1, "u1", '{"title": "t", "description": "d", "organizer": "", "tickets": ['
         '{"show_date": "2024-01-02 10:00", "description": "a", "price": 12.5, '
         '"number_of_tickets": 3}, {"show_date": "02/01/2024", "description": "b"}, '
         '{"show_date": "2024-01-02"}]}'),
        (2, "u1", '{"title": "t", "description": "d"}'),
        (3, "u1", '{"title": "", "description": "d", "tickets": []}'),
        (4, "u1", '{"title": "t", "description": "d", "tickets": []}'),
    )
    got = intake.event_requests(bodies)
    assert rows(got.rejects, "request_id") == {(2,), (3,)}
    errors = {r.request_id: r.error for r in got.rows.collect()}
    assert errors[4] is None
    assert errors[1] == (
        "encountered errors:\n"
        "error parsing show date '02/01/2024': expected format 2006-01-02 15:04\n"
        "error parsing show date '2024-01-02': expected format 2006-01-02 15:04"
    )
    good, bad = create_event_details(got.lines, NOW)
    assert rows(good, "show_date", "price", "tickets_remaining") == {
        (datetime(2024, 1, 2, 10), D("12.50"), 3)
    }
    assert rows(bad, "pos") == {(1,), (2,)}


def test_ticket_intake_requires_its_fields(table):
    bodies = table(
        "request_id INT, event_id STRING, body STRING",
        (1, "e1", '{"show_date": "x", "description": "a", "number_of_tickets": 3}'),
        (2, "e1", '{"show_date": "x", "description": "a", "number_of_tickets": 0}'),
        (3, "e1", '{"show_date": "x", "number_of_tickets": 3}'),
    )
    got = intake.ticket_requests(bodies)
    assert rows(got.rows, "request_id", "event_id") == {(1, "e1")}
    assert rows(got.rejects, "request_id") == {(2,), (3,)}


def test_reservation_intake(table):
    bodies = table(
        "request_id INT, requested_at TIMESTAMP_NTZ, user_id STRING, user_email STRING, body STRING",
        (1, T0, "u1", "u@x.com", '{"email": " ", "currency": "", "payment_method_id": "pm", '
         '"event_detail_reservations": [{"event_detail_id": "d1", "quantity": 2, "email": "g"}, '
         '{"event_detail_id": "d2"}]}'),
        (2, T0, "u1", "u@x.com", '{"payment_method_id": "", "event_detail_reservations": []}'),
        (3, T0, "u1", "u@x.com", '{"payment_method_id": "pm"}'),
        (4, T0, "u1", "u@x.com", '{"payment_method_id": "pm", "event_detail_reservations": '
         '[{"quantity": "two"}]}'),
        (5, T0, "u1", "u@x.com", '{"payment_method_id": "pm", "event_detail_reservations": []}'),
    )
    got = intake.reservation_requests(bodies)
    assert rows(got.rows, "request_id", "email", "currency") == {
        (1, "u@x.com", "usd"), (5, "u@x.com", "usd")
    }
    assert rows(got.lines, "request_id", "pos", "event_detail_id", "quantity", "email") == {
        (1, 0, "d1", 2, "g"), (1, 1, "d2", 0, None)
    }
    assert rows(got.rejects, "request_id") == {(2,), (3,), (4,)}


def test_create_payments_holds_for_fifteen_minutes(table):
    asks = table(
        "request_id INT, requested_at TIMESTAMP_NTZ, user_id STRING, currency STRING, "
        "total DECIMAL(20,2)",
        (1, T0, "u1", " ", D("12.50")),
    )
    one = create_payments(asks).first()
    assert (one.status, one.currency, one.amount) == ("pending", "usd", D("12.50"))
    assert one.expires_at == datetime(2024, 1, 1, 0, 15)
