"""Keyed lookups. A point lookup's parameter is a column of a key table, so one join answers a
whole batch. Every key stays in the result and ``found`` says whether it matched."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """The table is never broadcast: the planner goes by the size of its compressed files, and the rows
    that would pass through the driver can be a hundred times that."""
    marked = table.withColumn("found", F.lit(True))
    return keys.join(marked.hint("merge"), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def members(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among the given ones; a repeated key does not repeat a row."""
    return table.join(keys.select(on), on, "left_semi")


# --- events and ticket types ---------------------------------------------------


def user_events(keys: DataFrame, events: DataFrame) -> DataFrame:
    """keys(user_id): the events each user owns."""
    return lookup(keys, events, ["user_id"])


def user_event_by_id(keys: DataFrame, events: DataFrame) -> DataFrame:
    """keys(id, user_id): an event, only for its owner."""
    return lookup(keys, events, ["id", "user_id"])


def details_by_event(event_details: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(event_id): all ticket types of any of the events."""
    return members(event_details, keys, "event_id")


def detail_by_id(keys: DataFrame, event_details: DataFrame) -> DataFrame:
    """keys(id)"""
    return lookup(keys, event_details, ["id"])


def details_with_title(event_details: DataFrame, events: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(id): ticket types among the ids, with their event's title."""
    titles = events.select(F.col("id").alias("event_id"), "title")
    return (
        members(event_details, keys, "id")
        .join(titles, "event_id")
        .select("id", "title", "ticket_description", "show_date", "tickets_remaining", "price")
    )


def events_with_tickets(owned: DataFrame, event_details: DataFrame) -> DataFrame:
    """Owned events with their ticket types, one row per pair; an event without any keeps one
    row with NULLs. ``nest_tickets`` folds the rows into lists."""
    tickets = event_details.select(
        "event_id",
        F.col("id").alias("event_detail_id"),
        "show_date",
        "price",
        "number_of_tickets",
        "tickets_remaining",
        "ticket_description",
    )
    return owned.withColumnRenamed("id", "event_id").join(tickets, "event_id", "left")


# --- payments --------------------------------------------------------------------


def payment_by_id(keys: DataFrame, payments: DataFrame) -> DataFrame:
    """keys(id, user_id): a payment, only for its payer."""
    return lookup(keys, payments, ["id", "user_id"])


def payment_by_id_only(keys: DataFrame, payments: DataFrame) -> DataFrame:
    """keys(id)"""
    return lookup(keys, payments, ["id"])


def user_payments(keys: DataFrame, payments: DataFrame) -> DataFrame:
    """keys(user_id)"""
    return lookup(keys, payments, ["user_id"])


def multiple_payments(payments: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(id): payments among the ids."""
    return members(payments, keys, "id")


def payment_by_intent(keys: DataFrame, payments: DataFrame) -> DataFrame:
    """keys(payment_intent_id). Intent ids may repeat; the oldest payment (then the smallest id)
    stands for them. The choice is made before the join, so the join never multiplies rows."""
    rest = [n for n in payments.columns if n != "payment_intent_id"]
    first = (
        members(payments, keys, "payment_intent_id")
        .groupBy("payment_intent_id")
        .agg(F.min_by(F.struct(*rest), F.struct("created_at", "id")).alias("p"))
        .select("payment_intent_id", "p.*")
    )
    return lookup(keys, first, ["payment_intent_id"])


# --- reservations ------------------------------------------------------------------


def user_reservations(keys: DataFrame, reservations: DataFrame) -> DataFrame:
    """keys(user_id)"""
    return lookup(keys, reservations, ["user_id"])


def reservation_by_id(keys: DataFrame, reservations: DataFrame) -> DataFrame:
    """keys(id, user_id): a reservation, only for its holder."""
    return lookup(keys, reservations, ["id", "user_id"])


def reservations_by_payment(keys: DataFrame, reservations: DataFrame) -> DataFrame:
    """keys(user_id, payment_id)"""
    return lookup(keys, reservations, ["user_id", "payment_id"])


# --- users: the password never leaves the table ------------------------------------------


def user_by_email(keys: DataFrame, users: DataFrame) -> DataFrame:
    """keys(email), case-sensitive."""
    return lookup(keys, users.drop("password"), ["email"])


def user_by_id(keys: DataFrame, users: DataFrame) -> DataFrame:
    """keys(id)"""
    return lookup(keys, users.drop("password"), ["id"])
