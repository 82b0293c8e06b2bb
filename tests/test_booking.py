import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from boxoffice.operators import booking
from boxoffice.sources import schemas
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
NOW = datetime(2024, 2, 1)
LATER = datetime(2024, 3, 1)
D = Decimal
HEADERS = ("request_id INT, requested_at TIMESTAMP_NTZ, user_id STRING, user_email STRING, "
           "email STRING, currency STRING")
LINES = "request_id INT, pos INT, event_detail_id STRING, quantity INT, email STRING"


def detail(i, stock, price=10, show=LATER, event="e1"):
    return (i, show, D(price), stock, stock, f"tier {i}", T0, None, event)


def header(i, at=NOW):
    return (i, at, f"u{i}", f"u{i}@x.com", None, None)


@pytest.fixture
def details(table):
    return table(
        schemas.EVENT_DETAILS,
        detail("d1", 5), detail("d2", 2, 20), detail("free", 9, 0),
        detail("past", 9, show=T0), detail("now", 9, show=NOW),
    )


def quote(table, details, headers, lines):
    titled = details.selectExpr("*", "'Rock' as title")
    return booking.quote_requests(table(HEADERS, *headers), table(LINES, *lines), titled, NOW)


def test_quote(table, details):
    lines = [
        (1, 0, "d1", 2, None), (1, 1, "d2", 1, None),
        (2, 0, "d1", 1, None), (2, 1, "nope", 1, None), (2, 2, "d1", 99, None),
        (3, 0, "d2", 3, None), (3, 1, "nope", 1, None),
        (4, 0, "past", 1, None),
        (5, 0, "free", 2, None),
        (6, 0, "d1", 0, None),
        (8, 0, "d1", 3, None), (8, 1, "d1", -1, None),
        (9, 0, "now", 1, None),
        (10, 0, "d2", 2, None), (10, 1, "d2", 2, None),
    ]
    got = quote(table, details, [header(i) for i in range(1, 11)], lines)
    assert rows(got, "request_id", "outcome", "total") == {
        (1, "ok", D("40.00")),
        (2, "not_found", None),  # the first failing line names the outcome
        (3, "insufficient", None),
        (4, "show_past", None),
        (5, "ok", D("0.00")),
        (6, "no_tickets", None),
        (7, "no_tickets", None),
        (8, "invalid_quantity", None),
        (9, "ok", D("10.00")),  # a show that starts right now is not past
        (10, "ok", D("80.00")),  # each line fits alone; allocation will refuse
    }
    messages = {r.request_id: r.message for r in got.collect()}
    assert messages[2] == "event detail with ID nope not found"
    assert messages[3].endswith(": only 2 tickets remaining for Rock")
    assert messages[4] == (
        "error booking ticket, show date is already past: tier past, "
        "show date: 2024-01-01 00:00:00 +0000 +0000"
    )
    assert messages[6] == "no tickets being reserved"


def sequential(requests, stock):
    """The plain rule: requests in order, each takes all or nothing."""
    left, out = dict(stock), set()
    for request, wants in requests:
        need = {}
        for d, q in wants:
            need[d] = need.get(d, 0) + q
        if all(left[d] >= q for d, q in need.items()):
            for d, q in need.items():
                left[d] -= q
        else:
            out.add(request)
    return out, left


def demand(seed, n_requests, n_details, hot=False):
    rng = random.Random(seed)
    stock = {f"d{i}": rng.randrange(0, 25) for i in range(n_details)}
    if hot:
        stock["d0"] = n_requests // 2
    requests = []
    for i in range(n_requests):
        wants = [
            (rng.choice(list(stock)), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4))
        ]
        if hot:
            wants.append(("d0", rng.randrange(1, 3)))
        requests.append((i, wants))
    return requests, stock


@pytest.mark.parametrize(
    ("seed", "split", "hot"),
    [(1, 10**6, False), (2, 10**6, True), (3, 50, False), (5, 50, True)],
)
def test_allocation_equals_a_loop(spark, table, seed, split, hot):
    requests, stock = demand(seed, 150, 12, hot)
    want_out, want_left = sequential(requests, stock)
    base = table(schemas.EVENT_DETAILS, *[detail(k, n) for k, n in stock.items()])
    # Arrival: half of the requests share their second, the id decides.
    lines = table(
        "request_id INT, requested_at TIMESTAMP_NTZ, event_detail_id STRING, quantity INT",
        *[(i, NOW + timedelta(seconds=i // 2), d, q) for i, wants in requests for d, q in wants],
    )
    out = booking.decide_requests(lines, base, ["requested_at", "request_id"], split)
    got = sorted(r[0] for r in out.collect())
    assert got == sorted(want_out)


def test_a_chain_of_waiting_requests(table):
    # Each request shares a ticket type with the one before and one with the one after.
    stock = {f"d{i}": 1 for i in range(41)}
    requests = [(i, [(f"d{i}", 1), (f"d{i + 1}", 1)]) for i in range(40)]
    want_out, _ = sequential(requests, stock)
    base = table(schemas.EVENT_DETAILS, *[detail(k, n) for k, n in stock.items()])
    lines = table(
        "request_id INT, requested_at TIMESTAMP_NTZ, event_detail_id STRING, quantity INT",
        *[(i, NOW + timedelta(seconds=i), d, q) for i, wants in requests for d, q in wants],
    )
    rounds = []
    out = booking.decide_requests(lines, base, ["requested_at", "request_id"], rounds=rounds)
    assert sorted(r[0] for r in out.collect()) == sorted(want_out) == list(range(1, 40, 2))
    print("open lines after each round:", rounds)
    # Steps double: 3 + 6 + 12 + 24 of them are more than the chain is long.
    assert len(rounds) <= 4


def test_allocation_writes_everything(table, details):
    lines = [
        (1, 0, "d2", 1, "guest@x.com"), (1, 1, "d1", 2, " "),
        (2, 0, "d2", 1, None), (2, 1, "d2", 1, None),  # fits line by line, not together
        (3, 0, "d2", 1, None),
        (4, 0, "d2", 1, None),  # sold out by now
        (5, 0, "past", 1, None),
    ]
    at = [header(i, NOW + timedelta(minutes=i)) for i in range(1, 6)]
    quotes = quote(table, details, at, lines)
    new = booking.allocate_requests(
        quotes, table(LINES, *lines), details, ["requested_at", "request_id"]
    )
    assert rows(new["decisions"], "request_id", "outcome", "accepted") == {
        (1, "ok", True), (2, "sold_out", False), (3, "ok", True), (4, "sold_out", False),
        (5, "show_past", False),
    }
    assert rows(new["winners"], "request_id") == {(1,), (3,)}
    got = new["reservations"]
    assert sorted((r.user_id, r.event_detail_id, r.email) for r in got.collect()) == [
        ("u1", "d1", "u1@x.com"), ("u1", "d1", "u1@x.com"), ("u1", "d2", "guest@x.com"),
        ("u3", "d2", "u3@x.com"),
    ]
    assert got.select("id").distinct().count() == 4
    left = dict(rows(new["event_details"], "id", "tickets_remaining"))
    assert (left["d1"], left["d2"], left["past"]) == (3, 0, 9)


@pytest.mark.parametrize("seed", [11, 12])
def test_never_oversold_and_conserved(spark, table, seed):
    requests, stock = demand(seed, 120, 6, True)
    base = table(schemas.EVENT_DETAILS, *[detail(k, n) for k, n in stock.items()])
    lines = [(i, p, d, q, None) for i, w in requests for p, (d, q) in enumerate(w)]
    quotes = quote(table, base, [header(i) for i, _ in requests], lines)
    new = booking.allocate_requests(
        quotes, table(LINES, *lines), base, ["requested_at", "request_id"]
    )
    left = dict(rows(new["event_details"], "id", "tickets_remaining"))
    sold = {}
    for r in new["reservations"].collect():
        sold[r.event_detail_id] = sold.get(r.event_detail_id, 0) + 1
    assert all(n >= 0 for n in left.values())
    assert all(left[d] + sold.get(d, 0) == n for d, n in stock.items())
    wanted = {i: sum(q for _, q in w) for i, w in requests}
    winners = {r[0] for r in rows(new["winners"], "request_id")}
    assert sum(sold.values()) == sum(wanted[i] for i in winners)


OUTCOME_ROWS = [
    # payment, action, status, code, message, intent, reason, error
    ("p1", "succeeded", None, None, "pi1", None),
    ("p2", "requires_action", None, None, "pi2", None),
    ("p3", "canceled", None, None, "pi3", None),
    ("p4", "processing", None, None, "pi4", None),
    ("p5", "requires_payment_method", None, None, "pi5", None),
    ("p6", None, "card_declined", "Declined.", "pi6", "gateway"),
    ("p7", None, None, "reset", None, "other"),
    ("p8", "succeeded", None, None, "pi8", None),
]


def outcomes(table, action):
    return table(
        schemas.OUTCOMES,
        *[(p, action, s, code, m, i, None, e, f"secret {p}", "redirect", None) for p, s, code, m, i, e in OUTCOME_ROWS],
    )


def test_post_charge(table):
    pending = table(
        "payment_id STRING, total DECIMAL(20,2)",
        *[(f"p{i}", D(0) if i == 8 else D(10)) for i in range(1, 9)],
    )
    got = booking.post_charge_status(pending, outcomes(table, "charge"))
    assert rows(got, "payment_id", "status", "message", "payment_intent_id") == {
        ("p1", "succeeded", "payment successful", "pi1"),
        ("p2", "requires_action", "complete payment within next 15 minutes", "pi2"),
        ("p3", "canceled", "payment expired, please rebook your tickets", "pi3"),
        ("p4", "processing",
         "payment processing, we'll send you an email once payment succeeded", "pi4"),
        ("p5", "requires_payment_method", "please submit new payment method", "pi5"),
        ("p6", "card_declined", "Declined.", "pi6"),
        ("p7", "", "", None),
        ("p8", "succeeded", "free reservation successful", None),
    }
    assert rows(got.filter("client_secret is not null or next_action is not null"), "payment_id", "client_secret", "next_action") == {("p2", "secret p2", "redirect")}
    flags = {r.payment_id: (r.removed, r.notify, r.logged, r.log_description) for r in got.collect()}
    assert flags["p1"] == (False, True, True, "payment successful")
    assert flags["p2"] == (False, False, True, "payment successful")
    assert flags["p3"] == (True, False, True, "please refer to next action and status")
    assert flags["p7"] == (False, False, True, None)
    assert flags["p8"] == (False, True, False, None)


def test_retry(table):
    payments = table(
        schemas.PAYMENTS,
        *[(f"p{i}", None if i == 2 else f"pi{i}", D(10), "usd", "x", T0, T0, None, "u1")
          for i in range(1, 9)],
    )
    asks = table("payment_id STRING, user_id STRING",
                 ("p1", "u1"), ("p2", "u1"), ("p1", "u2"), ("p6", "u1"), ("p7", "u1"))
    got = booking.retry_payments(asks, payments, outcomes(table, "retry"))
    assert rows(got, "payment_id", "user_id", "outcome", "status", "message") == {
        ("p1", "u1", "updated", "succeeded", "payment updated"),
        ("p2", "u1", "no_intent", None, "payment record has no linked payment intent"),
        ("p1", "u2", "not_found", None, "payment not found"),
        ("p6", "u1", "updated", "card_declined", "Declined."),
        ("p7", "u1", "updated", "error", "an unknown error occurred with payment update"),
    }
    told = got.filter("client_secret is not null or next_action is not null")
    assert rows(told, "payment_id", "user_id", "client_secret") == {("p1", "u1", "secret p1")}


def test_apply_charges(table, details):
    payments = table(
        schemas.PAYMENTS,
        *[(f"p{i}", None, D(10), "usd", "pending", T0, T0, None, "u1") for i in (1, 2, 3, 7)],
    )
    reservations = table(
        schemas.RESERVATIONS,
        ("r1", "a@x.com", T0, None, "d1", "u1", "p3"), ("r2", "a@x.com", T0, None, "d2", "u1", "p1"),
    )
    pending = table(
        "payment_id STRING, user_id STRING, user_email STRING, payment_method_id STRING, "
        "total DECIMAL(20,2)",
        *[(f"p{i}", "u1", "a@x.com", "pm", D(10)) for i in (1, 2, 3, 7)],
    )
    charged = booking.post_charge_status(pending, outcomes(table, "charge"))
    new = booking.apply_charges(charged, payments, reservations, details, NOW)
    assert rows(new["payments"], "id", "status", "payment_intent_id") == {
        ("p1", "succeeded", "pi1"), ("p2", "requires_action", "pi2"), ("p7", "", None)
    }
    assert rows(new["reservations"], "id") == {("r2",)}
    assert dict(rows(new["event_details"], "id", "tickets_remaining"))["d1"] == 6
    logs = rows(booking.charge_logs(charged, NOW), "payment_id", "status", "description")
    assert logs == {
        ("p1", "succeeded", "payment successful"),
        ("p2", "requires_action", "payment successful"),
        ("p3", "canceled", "please refer to next action and status"),
        ("p7", "", None),
    }


def test_gateway_error_without_a_code(table, details):
    """The payment gets an empty status and the audit row is written."""
    payments = table(schemas.PAYMENTS, ("p1", None, D(10), "usd", "pending", T0, T0, None, "u1"))
    answer = table(schemas.OUTCOMES, ("p1", "charge", None, None, "Odd.", "pi1", None, "gateway", None, None, None))
    pending = table(
        "payment_id STRING, user_id STRING, user_email STRING, payment_method_id STRING, "
        "total DECIMAL(20,2)",
        ("p1", "u1", "a@x.com", "pm", D(10)),
    )
    charged = booking.post_charge_status(pending, answer)
    assert rows(charged, "status", "message", "removed", "notify") == {("", "Odd.", False, False)}
    new = booking.apply_charges(charged, payments, table(schemas.RESERVATIONS), details, NOW)
    assert rows(new["payments"], "id", "status", "payment_intent_id") == {("p1", "", "pi1")}
    assert rows(booking.charge_logs(charged, NOW), "status", "description") == {("", "Odd.")}


def test_a_total_beyond_the_money_type_takes_nothing(table):
    costly = table(schemas.EVENT_DETAILS, ("d1", NOW + timedelta(days=9), D("90000000"), 9, 9, "t", T0, None, "e1"))
    lines = [(1, 0, "d1", 2, None), (2, 0, "d1", 1, None)]
    quotes = quote(table, costly, [header(1), header(2)], lines)
    new = booking.allocate_requests(quotes, table(LINES, *lines), costly, ["requested_at", "request_id"])
    assert rows(new["decisions"], "request_id", "outcome", "accepted") == {
        (1, "payment_error", False), (2, "ok", True)
    }
    assert rows(new["event_details"], "tickets_remaining") == {(8,)}


def test_allocation_broadcasts_no_table(spark, monkeypatch, capsys):
    """The sizes of compressed files say little of the rows that would pass through the driver."""
    plans = []

    def written(df, *args):
        df.explain()
        plans.append(capsys.readouterr().out)
        return materialize(df, *args)

    materialize = booking.materialize
    monkeypatch.setattr(booking, "materialize", written)
    asked = [(r, r, T0, f"d{r % 3}", 2) for r in range(30)]
    lines = spark.createDataFrame(asked, "request_id long, pos long, requested_at timestamp_ntz, event_detail_id string, quantity int")
    details = spark.createDataFrame([(f"d{k}", 9, 9) for k in range(3)], "id string, number_of_tickets int, tickets_remaining int")
    quotes = spark.range(30).selectExpr(
        "id as request_id", "timestamp_ntz'2024-01-01 00:00:00' as requested_at", "'u' as user_id", "'u@x.com' as user_email", "'' as email", "'usd' as currency",
        "cast(id as decimal(20,2)) as total", "'ok' as outcome", "cast(null as string) as message",
    )
    got = booking.allocate_requests(quotes, lines.drop("requested_at").withColumn("email", F.lit("")), details, ["requested_at", "request_id"])
    for name in ("decisions", "winners", "reservations"):
        written(got[name], name)
    assert got["decisions"].filter("accepted").count() == 12
    assert len(plans) > 4 and any("SortMergeJoin" in plan for plan in plans)
    assert not any("BroadcastExchange" in plan for plan in plans)
