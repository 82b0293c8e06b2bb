"""JSON request bodies to typed rows. A body that fails its required fields becomes a reject.

Rows are kept or rejected by a generator and not by a filter: a filter on parsed fields would be
pushed below the parse, and every body would be parsed once more for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from boxoffice.functions import columns as c, fixed as fx
from boxoffice.sources import schemas

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Intake:
    """Good header rows, their exploded lines (if the body nests any) and the rejects."""

    rows: DataFrame
    lines: DataFrame | None
    rejects: DataFrame


def parse_bodies(bodies: DataFrame, schema: str) -> DataFrame:
    """Add ``r``, the parsed body; ``r._corrupt_record`` is set when it is no such JSON."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return bodies.withColumn("r", F.from_json("body", f"{schema}, {CORRUPT} STRING", options))


def _given(*fields: str) -> Column:
    """The body is whole and none of the text fields is missing or empty."""
    fine = F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()
    for field in fields:
        fine = fine & (F.col(f"r.{field}") != "")
    return F.coalesce(fine, F.lit(False))


def _keep(parsed: DataFrame, good: Column, *columns: Column | str) -> DataFrame:
    """The given columns of the good rows."""
    return parsed.select(F.inline(F.when(good, F.array(F.struct(*columns)))))


def _rejects(parsed: DataFrame, good: Column, key: str) -> DataFrame:
    return _keep(parsed, ~good, key, F.lit(fx.MSG_BAD_JSON).alias("message"))


def registrations(bodies: DataFrame) -> Intake:
    """``bodies(seq, body)``: sign-ups with all four fields given."""
    fields = ("firstname", "lastname", "email", "password")
    parsed = parse_bodies(bodies, schemas.REGISTRATION)
    good = _given(*fields)
    rows = _keep(parsed, good, "seq", *[F.col(f"r.{f}").alias(f) for f in fields])
    return Intake(rows, None, _rejects(parsed, good, "seq"))


def reservation_requests(bodies: DataFrame, key_type: str = "string") -> Intake:
    """``bodies(request_id, requested_at, user_id, user_email, body)``: header plus lines.
    The lines repeat the header's columns, so that they need no join with it.

    A blank header e-mail falls back to the requester's, a blank currency to the default.
    Fields of a line are not required: a missing quantity is 0.
    """
    parsed = parse_bodies(bodies, schemas.RESERVATION_REQUEST.format(key=key_type))
    good = _given("payment_method_id") & F.col("r.event_detail_reservations").isNotNull()
    header = [
        "request_id",
        "requested_at",
        "user_id",
        "user_email",
        c.first_not_blank("r.email", "user_email").alias("request_email"),
        c.first_not_blank("r.currency", F.lit(fx.DEFAULT_CURRENCY)).alias("currency"),
        F.col("r.payment_method_id").alias("payment_method_id"),
    ]
    rows = _keep(parsed, good, *header).withColumnRenamed("request_email", "email")
    lines = parsed.select(
        *header, F.posexplode(F.when(good, F.col("r.event_detail_reservations"))).alias("pos", "l")
    )
    names = [n for n in lines.columns if n != "l"]
    lines = lines.select(
        *names,
        "l.event_detail_id",
        F.coalesce("l.quantity", F.lit(0)).alias("quantity"),
        "l.email",
    )
    return Intake(rows, lines, _rejects(parsed, good, "request_id"))


def event_requests(bodies: DataFrame) -> Intake:
    """``bodies(request_id, user_id, body)``: an event with its nested ticket types.

    The header keeps ``error``, the roll-up of all ticket types whose show date is no date.
    It is built inside the row, from the request's own list.
    """
    parsed = parse_bodies(bodies, schemas.EVENT_REQUEST)
    good = _given("title", "description") & F.col("r.tickets").isNotNull()
    event_id = c.derived_id(F.lit("event"), "request_id")
    bad = F.filter("r.tickets", lambda t: c.parse_show_date(t["show_date"]).isNull())
    messages = F.transform(bad, lambda t: show_date_error(t["show_date"]))
    rows = _keep(
        parsed,
        good,
        event_id.alias("id"),
        "request_id",
        F.col("r.title").alias("title"),
        F.col("r.description").alias("description"),
        c.null_if_blank_text("r.organizer").alias("organizer"),
        "user_id",
        F.when(
            F.size(bad) > 0,
            F.concat(F.lit(fx.MSG_INTAKE_ERRORS), F.array_join(messages, "\n")),
        ).alias("error"),
    )
    lines = parsed.select(
        "request_id",
        event_id.alias("event_id"),
        F.posexplode(F.when(good, F.col("r.tickets"))).alias("pos", "t"),
    ).select(
        "request_id",
        "event_id",
        "pos",
        "t.show_date",
        F.col("t.description").alias("ticket_description"),
        F.coalesce("t.price", F.lit(0)).cast(fx.MONEY).alias("price"),
        F.coalesce("t.number_of_tickets", F.lit(0)).alias("number_of_tickets"),
    )
    return Intake(rows, lines, _rejects(parsed, good, "request_id"))


def ticket_requests(bodies: DataFrame) -> Intake:
    """``bodies(request_id, event_id, body)``: one ticket type for an event that exists. Here
    show date, description and number of tickets are required."""
    parsed = parse_bodies(bodies, schemas.TICKET_REQUEST)
    good = _given("show_date", "description") & (
        F.coalesce("r.number_of_tickets", F.lit(0)) != 0
    )
    rows = _keep(
        parsed,
        good,
        "event_id",
        F.lit(0).alias("pos"),
        F.col("r.show_date").alias("show_date"),
        F.col("r.description").alias("ticket_description"),
        F.coalesce("r.price", F.lit(0)).cast(fx.MONEY).alias("price"),
        F.col("r.number_of_tickets").alias("number_of_tickets"),
        "request_id",
    )
    return Intake(rows, None, _rejects(parsed, good, "request_id"))


def show_date_error(show_date: Column) -> Column:
    return c.text(fx.MSG_BAD_SHOW_DATE, show_date, F.lit(fx.SHOW_DATE_FORMAT))
