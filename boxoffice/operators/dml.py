"""UPDATE and DELETE in bulk. Parquet has no MERGE, so each operator returns the new version of
every table it changes; the caller writes it to a new path.

A request table carries ``seq``. Where several requests set the same row, the last one wins.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxoffice.functions import columns as c
from boxoffice.functions.scale import SPLIT_ROWS, running, slice_hot_keys


def update_rows(
    table: DataFrame,
    requests: DataFrame,
    keys: list[str],
    values: dict[str, str],
    as_of: datetime | str | Column | None = None,
) -> DataFrame:
    """Set ``values`` (table column: request column) where all ``keys`` match. ``as_of`` is put
    into updated_at; without it that column is left alone. ``updated`` marks the rows hit."""
    picked = F.struct(*[F.col(source).alias(target) for target, source in values.items()])
    latest = requests.groupBy(*keys).agg(F.max_by(picked, "seq").alias("new"))
    hit = F.col("new").isNotNull()

    def column(name: str) -> Column:
        if name in values:
            kind = table.schema[name].dataType
            return F.when(hit, F.col(f"new.{name}").cast(kind)).otherwise(F.col(name)).alias(name)
        if name == "updated_at" and as_of is not None:
            return F.when(hit, c.clock(as_of)).otherwise(F.col(name)).alias(name)
        return F.col(name)

    joined = table.join(latest, keys, "left")
    return joined.select(*[column(n) for n in table.columns], hit.alias("updated"))


def update_event(events: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """requests(seq, id, user_id, title, description, organizer); only the owner may."""
    named = requests.withColumn("organizer", c.null_if_blank_text("organizer"))
    same = {n: n for n in ("title", "description", "organizer")}
    return update_rows(events, named, ["id", "user_id"], same, as_of)


def update_event_detail(event_details: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """requests(seq, id, event_id, show_date text, price, number_of_tickets,
    ticket_description). Requests whose show date is no date are left out. Tickets remaining do
    not follow the new number of tickets."""
    parsed = requests.withColumn("show_date", c.parse_show_date("show_date")).filter(
        F.col("show_date").isNotNull()
    )
    same = {n: n for n in ("show_date", "price", "number_of_tickets", "ticket_description")}
    return update_rows(event_details, parsed, ["id", "event_id"], same, as_of)


def update_tickets_remaining(event_details: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """requests(seq, id, tickets_remaining)"""
    return update_rows(
        event_details, requests, ["id"], {"tickets_remaining": "tickets_remaining"}, as_of
    )


def update_payment(payments: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """requests(seq, id, user_id, amount, status, payment_intent_id); only the payer's id hits. A
    request whose amount is beyond the money type is left out."""
    requests = requests.filter(F.col("amount").isNull() | c.money("amount").isNotNull())
    same = {n: n for n in ("amount", "status", "payment_intent_id")}
    return update_rows(payments, requests, ["id", "user_id"], same, as_of)


def update_reservation_email(reservations: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """requests(seq, id, user_id, email)"""
    return update_rows(reservations, requests, ["id", "user_id"], {"email": "email"}, as_of)


# --- inventory ---------------------------------------------------------------------


def reserve_tickets(
    requests: DataFrame,
    event_details: DataFrame,
    order: list[str],
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """requests(event_detail_id, <order>): single-ticket requests in arrival order. A request is
    served while its ticket type has tickets left.

    Only requests before it count, so the n-th request for a type is served iff n <= remaining.
    """
    stock = event_details.select(F.col("id").alias("event_detail_id"), "tickets_remaining")
    ready = slice_hot_keys(requests, ["event_detail_id"], order, split_rows)
    ranked = running(ready, ["event_detail_id"], order, sums={"before": F.lit(1)})
    served = F.coalesce(F.col("before") < F.col("tickets_remaining"), F.lit(False))
    return (
        ranked.join(stock, "event_detail_id", "left")
        .withColumn("reserved", served)
        .select(*requests.columns, "reserved")
    )


def take_tickets(event_details: DataFrame, taken: DataFrame) -> DataFrame:
    """taken(event_detail_id, tickets): the new inventory; updated_at is not touched."""
    return _shift_inventory(event_details, taken, -1)


def restore_tickets(event_details: DataFrame, restored: DataFrame) -> DataFrame:
    """restored(event_detail_id, tickets)"""
    return _shift_inventory(event_details, restored, 1)


def _shift_inventory(event_details: DataFrame, moves: DataFrame, sign: int) -> DataFrame:
    totals = moves.groupBy(F.col("event_detail_id").alias("id")).agg(
        F.sum("tickets").alias("moved")
    )
    left = (F.col("tickets_remaining") + sign * F.coalesce("moved", F.lit(0))).cast("int")
    return (
        event_details.join(totals, "id", "left")
        .withColumn("tickets_remaining", left)
        .select(*event_details.columns)
    )


def restore_and_delete_payments(
    requests: DataFrame,
    payments: DataFrame,
    reservations: DataFrame,
    event_details: DataFrame,
) -> dict[str, DataFrame]:
    """requests(seq, payment_id, user_id): give a payment's tickets back, then delete it.

    Tickets come back for any requester; the payment goes only for its payer, and only if it had
    tickets to give back. In arrival order, each request up to and including the one that
    deletes the payment gives its tickets back once more.
    """
    owner = payments.select(F.col("id").alias("payment_id"), F.col("user_id").alias("payer"))
    tagged = requests.join(owner, "payment_id", "left").withColumn(
        "owns", F.coalesce(F.col("user_id") == F.col("payer"), F.lit(False))
    )
    end_seq = F.min(F.when(F.col("owns"), F.col("seq"))).over(Window.partitionBy("payment_id"))
    rounds = (
        tagged.withColumn("end_seq", end_seq)
        .filter(F.col("payment_id").isNotNull())
        .filter(F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq")))
        .groupBy("payment_id")
        .agg(F.count("*").alias("times"), F.bool_or("owns").alias("owns"))
    )
    known = event_details.select(F.col("id").alias("event_detail_id"))
    # Each reservation of an asked payment is one ticket; they are summed up per ticket type alone.
    given_back = (
        reservations.select("payment_id", "event_detail_id")
        .join(rounds, "payment_id")
        .join(known, "event_detail_id", "left_semi")
        .select("payment_id", "event_detail_id", "owns", F.col("times").alias("tickets"))
    )
    gone = given_back.filter("owns").select("payment_id").distinct()
    return {
        "event_details": restore_tickets(event_details, given_back),
        "payments": payments.join(
            gone.withColumnRenamed("payment_id", "id"), "id", "left_anti"
        ).select(*payments.columns),
        "reservations": reservations.join(gone, "payment_id", "left_anti").select(
            *reservations.columns
        ),
    }


def refund_and_restore(
    requests: DataFrame,
    payments: DataFrame,
    reservations: DataFrame,
    event_details: DataFrame,
) -> dict[str, DataFrame]:
    """requests(event_detail_id, amount, payment_id, user_id, reservation_id): one ticket back,
    the amount off the payment, the reservation deleted.

    The three changes read the same snapshot and do not wait for each other: the ticket comes
    back even if the payment is not the user's; the reservation goes only if both others hit.
    """
    back = requests.groupBy("event_detail_id").agg(F.count("*").alias("tickets"))
    off = requests.groupBy(F.col("payment_id").alias("id"), "user_id").agg(
        F.sum("amount").alias("off")
    )
    lowered = (
        payments.join(off, ["id", "user_id"], "left")
        .withColumn("amount", F.coalesce(c.money(F.col("amount") - F.coalesce("off", F.lit(0))), "amount"))
        .select(*payments.columns)
    )
    known = event_details.select(F.col("id").alias("event_detail_id"))
    owners = payments.select(F.col("id").alias("payment_id"), "user_id")
    gone = (
        requests.join(known, "event_detail_id", "left_semi")
        .join(owners, ["payment_id", "user_id"], "left_semi")
        .select(F.col("reservation_id").alias("id"))
    )
    return {
        "event_details": restore_tickets(event_details, back),
        "payments": lowered,
        "reservations": reservations.join(gone, "id", "left_anti").select(*reservations.columns),
    }


# --- deletes and their cascade ----------------------------------------------------------


def cascade_delete(
    tables: dict[str, DataFrame],
    users: DataFrame | None = None,
    events: DataFrame | None = None,
    event_details: DataFrame | None = None,
    payments: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """New versions after deleting the given ids (one column ``id`` each) and every row that
    hangs on them. The payment log hangs on nothing and stays whole."""
    gone = {"users": users, "events": events, "event_details": event_details, "payments": payments}
    parents = {
        "events": [("user_id", "users")],
        "event_details": [("event_id", "events")],
        "payments": [("user_id", "users")],
        "reservations": [
            ("event_detail_id", "event_details"),
            ("user_id", "users"),
            ("payment_id", "payments"),
        ],
    }
    out = dict(tables)
    for name in ("users", "events", "event_details", "payments", "reservations"):
        if name not in tables:
            continue
        table = tables[name]
        links = [(k, p) for k, p in parents.get(name, []) if gone.get(p) is not None]
        orphans = [
            table.join(gone[p].select(F.col("id").alias(k)), k, "left_semi").select("id")
            for k, p in links
        ]
        kept = table
        for key, parent in links:
            kept = kept.join(gone[parent].select(F.col("id").alias(key)), key, "left_anti")
        if gone.get(name) is not None:
            kept = kept.join(gone[name].select("id"), "id", "left_anti")
        out[name] = kept.select(*table.columns)
        if name == "reservations":
            continue
        for more in orphans:
            gone[name] = more if gone[name] is None else gone[name].select("id").unionByName(more)
    return out


def delete_events(requests: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """requests(id, user_id): events deleted by their owner, with the cascade. ``deletions``
    says how many events each request deleted."""
    owned = tables["events"].select("id", "user_id")
    return _delete("events", requests, owned, ["id", "user_id"], tables)


def delete_event_details(
    requests: DataFrame, tables: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """requests(id, event_id): ticket types deleted out of their event, with the cascade."""
    placed = tables["event_details"].select("id", "event_id")
    return _delete("event_details", requests, placed, ["id", "event_id"], tables)


def _delete(name, requests, table, keys, tables) -> dict[str, DataFrame]:
    doomed = table.join(requests.select(*keys), keys, "left_semi").select("id")
    new = cascade_delete(tables, **{name: doomed})
    marked = table.withColumn("deleted", F.lit(1))
    new["deletions"] = (
        requests.select(*keys)
        .distinct()
        .join(marked, keys, "left")
        .withColumn("deleted", F.coalesce("deleted", F.lit(0)))
    )
    return new
