"""INSERT statements as row builders. The caller appends the rows to the table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from boxoffice.functions import columns as c, fixed as fx
from boxoffice.sources.intake import show_date_error


def _never() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def check_registrations(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows(seq, firstname, lastname, email, password): the first rule a sign-up breaks, or
    ``accepted``. E-mails are unique: against the table and, by ``seq``, inside the batch.

    The password column is dropped once its rule is checked. An address that very many sign-ups
    share is settled by one minimum, not by sorting its rows.
    """
    judged = rows.select(
        "seq",
        "firstname",
        "lastname",
        "email",
        F.when(~c.is_email_valid("email"), "invalid_email")
        .when(~c.is_password_valid("password"), "weak_password")
        .alias("broken"),
    )
    claims = judged.filter(F.col("broken").isNull()).select(
        "email", "seq", F.lit(False).alias("known")
    )
    known = users.select("email", F.lit(None).cast("long").alias("seq"), F.lit(True).alias("known"))
    holders = claims.unionByName(known).groupBy("email").agg(
        F.bool_or("known").alias("known"), F.min("seq").alias("first_seq")
    )
    outcome = F.coalesce(
        F.col("broken"),
        F.when(F.col("known") | (F.col("seq") != F.col("first_seq")), "email_taken"),
        F.lit("accepted"),
    )
    return (
        judged.join(holders, "email", "left")
        .withColumn("outcome", outcome)
        .select(
            "seq",
            "firstname",
            "lastname",
            "email",
            "outcome",
            F.when(F.col("outcome") == "invalid_email", fx.MSG_EMAIL_INVALID)
            .when(F.col("outcome") == "weak_password", fx.MSG_PASSWORD_WEAK)
            .when(F.col("outcome") == "email_taken", fx.MSG_EMAIL_TAKEN)
            .alias("message"),
        )
    )


def create_users(checked: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Rows for the accepted sign-ups. Ids come from the e-mail, which is unique over all batches. The
    password hash is made outside of this package."""
    return checked.filter(F.col("outcome") == "accepted").select(
        c.derived_id(F.lit("user"), "email").alias("id"),
        "firstname",
        "lastname",
        "email",
        c.clock(as_of).alias("created_at"),
        _never().alias("updated_at"),
    )


def create_events(headers: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    return headers.select(
        "id",
        "title",
        "description",
        c.null_if_blank_text("organizer").alias("organizer"),
        c.clock(as_of).alias("created_at"),
        _never().alias("updated_at"),
        "user_id",
    )


def create_event_details(
    lines: DataFrame, as_of: datetime | str | Column
) -> tuple[DataFrame, DataFrame]:
    """lines(event_id, pos, show_date text, ...): the good ticket types, all tickets remaining,
    and the rejects with their message. A bad line does not stop its event's good ones."""
    parsed = lines.withColumn("shown", c.parse_show_date("show_date"))
    good = parsed.filter(F.col("shown").isNotNull()).select(
        c.derived_id(F.lit("detail"), "event_id", "pos").alias("id"),
        F.col("shown").alias("show_date"),
        "price",
        "number_of_tickets",
        F.col("number_of_tickets").alias("tickets_remaining"),
        "ticket_description",
        c.clock(as_of).alias("created_at"),
        _never().alias("updated_at"),
        "event_id",
    )
    bad = parsed.filter(F.col("shown").isNull()).select(
        "event_id", "pos", "show_date", show_date_error(F.col("show_date")).alias("message")
    )
    return good, bad


def create_payments(requests: DataFrame) -> DataFrame:
    """requests(request_id, requested_at, user_id, currency, total): one pending payment each, where
    the total fits the money type."""
    return requests.filter(c.money("total").isNotNull()).select(
        c.derived_id(F.lit("payment"), "request_id").alias("id"),
        F.lit(None).cast("string").alias("payment_intent_id"),
        c.money("total").alias("amount"),
        c.first_not_blank("currency", F.lit(fx.DEFAULT_CURRENCY)).alias("currency"),
        F.lit(fx.PENDING).alias("status"),
        (F.col("requested_at") + F.expr(f"interval {fx.PAYMENT_HOLD_MINUTES} minutes")).alias(
            "expires_at"
        ),
        F.col("requested_at").alias("created_at"),
        _never().alias("updated_at"),
        "user_id",
    )


def create_payment_logs(
    entries: DataFrame, payers: DataFrame, as_of: datetime | str | Column
) -> DataFrame:
    """entries(log_key, status, description, payment_intent_id, payment_method_id, amount,
    payment_id, user_id): audit rows, where the amount fits the money type. ``payers`` is the users
    table."""
    entries = entries.filter(c.money("amount").isNotNull())
    emails = payers.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    return entries.join(emails, "user_id", "left").select(
        c.derived_id(F.lit("log"), "log_key").alias("id"),
        "status",
        c.null_if_blank_text("description").alias("description"),
        F.coalesce("payment_intent_id", F.lit("")).alias("payment_intent_id"),
        c.null_if_blank_text("payment_method_id").alias("payment_method_id"),
        c.money("amount").alias("amount"),
        c.clock(as_of).alias("created_at"),
        F.coalesce("user_email", F.lit(fx.UNKNOWN_EMAIL)).alias("user_email"),
        "payment_id",
    )
