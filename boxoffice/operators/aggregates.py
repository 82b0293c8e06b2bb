"""Joins and totals over the booking tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxoffice.functions import columns as c, fixed as fx


def payment_reservation_details(
    keys: DataFrame,
    payments: DataFrame,
    reservations: DataFrame,
    event_details: DataFrame,
    events: DataFrame,
) -> DataFrame:
    """keys(payment_id, user_id): each payment of its payer with its reservations, ticket types
    and events. All joins stay left: a missing part shows as NULL."""
    paid = payments.select(
        F.col("id").alias("payment_id"), "payment_intent_id", "user_id", "amount", "status"
    )
    booked = reservations.select(
        F.col("id").alias("reservation_id"), "email", "event_detail_id", "payment_id"
    )
    tiers = event_details.select(
        F.col("id").alias("event_detail_id"),
        "ticket_description",
        "show_date",
        "price",
        "event_id",
        F.lit(True).alias("has_detail"),
    )
    titles = events.select(F.col("id").alias("event_id"), "title")
    # The ticket type's own columns, its id included, are NULL when it is missing.
    detail = F.when(F.col("has_detail"), F.col("event_detail_id")).alias("event_detail_id")
    rows = (
        keys.select("payment_id", "user_id")
        .join(paid, ["payment_id", "user_id"])
        .join(booked, "payment_id", "left")
        .join(tiers, "event_detail_id", "left")
        .join(titles, "event_id", "left")
    )
    return rows.select(
        "payment_id",
        "payment_intent_id",
        "user_id",
        "amount",
        "status",
        "reservation_id",
        "email",
        detail,
        "title",
        "ticket_description",
        "show_date",
        "price",
    )


def event_refund_totals(
    requests: DataFrame,
    events: DataFrame,
    event_details: DataFrame,
    reservations: DataFrame,
    payments: DataFrame,
) -> DataFrame:
    """requests(event_id, user_id): what each payment put into the owner's event, one row per
    payment and ticket price.

    The price is part of the group, so two price tiers give two rows and equal prices merge.
    Totals are summed before the join with payments, which then sees one row per group.
    """
    owned = events.select(F.col("id").alias("event_id"), "user_id", "title").join(
        requests.select("event_id", "user_id"), ["event_id", "user_id"], "left_semi"
    )
    tiers = event_details.select(F.col("id").alias("event_detail_id"), "event_id", "price").join(
        owned.select("event_id", "title"), "event_id"
    )
    # Dealt out by payment once: all that follows up to the answers of the gateway joins by payment.
    totals = (
        reservations.select("event_detail_id", "payment_id")
        .filter(F.col("payment_id").isNotNull())
        .join(tiers, "event_detail_id")
        .repartition("payment_id")
        .groupBy("payment_id", "event_id", "title", "price")
        .agg(F.sum("price").cast(fx.MONEY_SUM).alias("ticket_price"))
    )
    paid = payments.select(
        F.col("id").alias("payment_id"),
        "payment_intent_id",
        F.col("user_id").alias("payer_user_id"),
        "amount",
        "status",
    )
    return totals.join(paid, "payment_id").select(
        "event_id",
        "payment_id",
        "payment_intent_id",
        "payer_user_id",
        "amount",
        "status",
        "title",
        "price",
        "ticket_price",
    )


def detail_refund_totals(
    requests: DataFrame,
    events: DataFrame,
    event_details: DataFrame,
    reservations: DataFrame,
    payments: DataFrame,
    users: DataFrame,
) -> DataFrame:
    """requests(event_detail_id, user_id): what each payment put into one ticket type of the
    owner's event. Payments without a user row drop out."""
    owners = events.select(F.col("id").alias("event_id"), "user_id", "title")
    tiers = (
        event_details.select(
            F.col("id").alias("event_detail_id"), "event_id", "price", "ticket_description"
        )
        .join(owners, "event_id")
        .join(
            requests.select("event_detail_id", "user_id"),
            ["event_detail_id", "user_id"],
            "left_semi",
        )
        .select("event_detail_id", "title", "ticket_description", "price")
    )
    # Numbers alone are summed up; texts come to the totals. Equal rows of a ticket type count as often.
    tiers = tiers.groupBy(*tiers.columns).agg(F.count("*").alias("times"))
    totals = tickets_per_payment(reservations).join(tiers, "event_detail_id").select(
        "payment_id",
        "event_detail_id",
        "title",
        "ticket_description",
        (F.col("price") * F.col("tickets") * F.col("times")).cast(fx.MONEY_SUM).alias("ticket_price"),
    )
    paid = payments.select(
        F.col("id").alias("payment_id"),
        "payment_intent_id",
        F.col("user_id").alias("payer_user_id"),
        "amount",
        "status",
        "created_at",
    ).join(users.select(F.col("id").alias("payer_user_id")), "payer_user_id", "left_semi")
    return totals.join(paid, "payment_id").select(
        "event_detail_id",
        "payment_id",
        "payment_intent_id",
        "payer_user_id",
        "amount",
        "status",
        "created_at",
        "title",
        "ticket_description",
        "ticket_price",
    )


def tickets_per_payment(reservations: DataFrame) -> DataFrame:
    """Tickets of each ticket type inside a payment."""
    return reservations.groupBy("payment_id", "event_detail_id").agg(
        F.count("*").cast("int").alias("tickets")
    )


def confirmed_attendees(
    keys: DataFrame,
    event_details: DataFrame,
    reservations: DataFrame,
    payments: DataFrame,
    users: DataFrame,
) -> DataFrame:
    """keys(event_id): distinct payers of succeeded payments. Pairs of event and payer are made
    distinct before the join with users."""
    tiers = event_details.select(F.col("id").alias("event_detail_id"), "event_id").join(
        keys.select("event_id"), "event_id", "left_semi"
    )
    paid = payments.filter(F.col("status") == fx.SUCCEEDED).select(
        F.col("id").alias("payment_id"), "user_id"
    )
    pairs = (
        reservations.select("event_detail_id", "payment_id")
        .join(tiers, "event_detail_id")
        .select("event_id", "payment_id")
        .distinct()
        .join(paid, "payment_id")
        .select("event_id", "user_id")
        .distinct()
    )
    people = users.select(
        F.col("id").alias("user_id"),
        c.full_name("firstname", "lastname").alias("full_name"),
        "email",
    )
    return pairs.join(people, "user_id").select("event_id", "user_id", "full_name", "email")


def nest_tickets(rows: DataFrame) -> DataFrame:
    """Fold ``events_with_tickets`` rows into ``tickets``, one whole list per event in the order of
    the ticket types' ids; an event without a ticket type has an empty one.

    A list is one row of the answer and so as large as the event's own ticket types are. Who wants
    no list reads the flat rows.
    """
    ticket = [
        "show_date", "price", "number_of_tickets", "tickets_remaining", "ticket_description"
    ]
    head = [n for n in rows.columns if n not in ticket and n != "event_detail_id"]
    item = F.when(
        F.col("event_detail_id").isNotNull(),
        F.struct(F.col("event_detail_id").alias("id"), *ticket),
    )
    return rows.groupBy(*head).agg(F.array_sort(F.collect_list(item)).alias("tickets"))
