"""Notification outbox: one row per mail instead of sending it.

A mail lists all of a payment's ticket types. ``mail_lines`` has the same lines one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boxoffice.functions import columns as c, fixed as fx

TEAM_SIGNATURE = "- The booking team"
TEAM_NAME = "Booking team"
TEAM_EMAIL = "team@example.com"


def recipient(name, email):
    return F.concat(name, F.lit(" <"), email, F.lit(">"))


def mail_lines(
    reservations: DataFrame, payments: DataFrame, details: DataFrame, wanted: DataFrame
) -> DataFrame:
    """wanted(payment_id): per payment and ticket type, the line that tells of it.

    Only the payer's own reservations count. details(id, title, ticket_description, show_date).
    """
    payers = payments.select(F.col("id").alias("payment_id"), "user_id").join(
        wanted.select("payment_id"), "payment_id", "left_semi"
    )
    held = (
        reservations.select("payment_id", "user_id", "event_detail_id")
        .join(payers, ["payment_id", "user_id"])
        .select("payment_id", "event_detail_id")
        .distinct()
    )
    text = c.text(
        fx.MAIL_LINE, F.col("title"), F.col("ticket_description"), c.mail_time("show_date")
    )
    return held.join(
        details.select(F.col("id").alias("event_detail_id"), text.alias("line")), "event_detail_id"
    ).select("payment_id", "event_detail_id", "line")


def ticket_lines(
    reservations: DataFrame, payments: DataFrame, details: DataFrame, wanted: DataFrame
) -> DataFrame:
    """wanted(payment_id): per payment, the lines of all its ticket types as one text, in the order
    of the ticket types' ids."""
    item = F.struct("event_detail_id", "line")
    listed = (
        mail_lines(reservations, payments, details, wanted)
        .groupBy("payment_id")
        .agg(F.array_sort(F.collect_list(item)).alias("l"))
    )
    return listed.select(
        "payment_id", F.concat(F.array_join(F.col("l.line"), "\n"), F.lit("\n")).alias("lines")
    )


def payers_of(payments: DataFrame, users: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(payment_id): who paid those payments. They are picked before users are joined."""
    people = users.select(
        F.col("id").alias("user_id"),
        c.full_name("firstname", "lastname").alias("name"),
        "email",
    )
    return (
        payments.select(F.col("id").alias("payment_id"), "user_id")
        .join(wanted.select("payment_id"), "payment_id", "left_semi")
        .join(people, "user_id", "left")
        .drop("user_id")
    )


def bookers_of(charged: DataFrame, users: DataFrame) -> DataFrame:
    """charged(payment_id, user_id, user_email): who booked. The mail goes to the address of the
    request; an unknown user is greeted by it too."""
    names = users.select(
        F.col("id").alias("user_id"), c.full_name("firstname", "lastname").alias("name")
    )
    return charged.join(names, "user_id", "left").select(
        "payment_id",
        F.coalesce("name", "user_email").alias("name"),
        F.col("user_email").alias("email"),
    )


def confirmation_mails(
    paid: DataFrame, payers: DataFrame, lines: DataFrame, team: str = TEAM_SIGNATURE
) -> DataFrame:
    """paid(mail_key, payment_id): "your booking is confirmed"."""
    return (
        paid.select("mail_key", "payment_id")
        .join(lines, "payment_id")
        .join(payers, "payment_id")
        .select(
            "mail_key",
            "payment_id",
            recipient(F.col("name"), F.col("email")).alias("recipient"),
            F.lit(fx.SUBJECT_CONFIRMED).alias("subject"),
            c.fill(fx.BODY_CONFIRMED, name=F.col("name"), lines=F.col("lines"), team=team).alias(
                "body"
            ),
        )
    )


def failure_mails(
    failed: DataFrame, payers: DataFrame, lines: DataFrame, team: str = TEAM_SIGNATURE
) -> DataFrame:
    """failed(mail_key, payment_id, error_message): "your payment failed"."""
    return (
        failed.select("mail_key", "payment_id", "error_message")
        .join(lines, "payment_id")
        .join(payers, "payment_id")
        .select(
            "mail_key",
            "payment_id",
            recipient(F.col("name"), F.col("email")).alias("recipient"),
            F.lit(fx.SUBJECT_FAILED).alias("subject"),
            c.fill(
                fx.BODY_FAILED,
                name=F.col("name"),
                error=F.col("error_message"),
                lines=F.col("lines"),
                team=team,
            ).alias("body"),
        )
    )


def event_cancelled_mails(plan: DataFrame, payers: DataFrame) -> DataFrame:
    """One notice per cancelled event and payment of an ``event_cancel_plan``."""
    told = plan.filter("notify").select("event_id", "payment_id", "title").distinct()
    return _cancelled(
        told, payers, "event_id", c.fill(fx.BODY_EVENT_CANCELLED, title=F.col("title"))
    )


def detail_cancelled_mails(
    plan: DataFrame, payers: DataFrame, team: str = TEAM_SIGNATURE
) -> DataFrame:
    """One notice per cancelled ticket type and payment of a ``detail_cancel_plan``."""
    keys = ["event_detail_id", "payment_id", "title", "ticket_description"]
    told = plan.filter("notify").select(*keys).distinct()
    body = c.fill(
        fx.BODY_DETAIL_CANCELLED,
        name=F.col("name"),
        title=F.col("title"),
        ticket=F.col("ticket_description"),
        team=team,
    )
    return _cancelled(told, payers, "event_detail_id", body)


def _cancelled(told: DataFrame, payers: DataFrame, key: str, body) -> DataFrame:
    missing = F.col("email").isNull()
    return told.join(payers, "payment_id", "left").select(
        key,
        "payment_id",
        recipient(F.col("name"), F.col("email")).alias("recipient"),
        F.when(~missing, c.fill(fx.SUBJECT_CANCELLED, title=F.col("title"))).alias("subject"),
        F.when(~missing, body).alias("body"),
        F.when(
            missing, c.text("failed to get user email for payment %s", F.col("payment_id"))
        ).alias("failure"),
    )


def refund_error_mails(
    errors: DataFrame, name: str = TEAM_NAME, email: str = TEAM_EMAIL, keep: tuple[str, ...] = ()
) -> DataFrame:
    """errors(mail_key, and the columns ``keep``): a note to the team for every refund that failed."""
    return errors.select(
        "mail_key",
        *keep,
        F.lit(f"{name} <{email}>").alias("recipient"),
        F.lit(fx.SUBJECT_REFUND_ERROR).alias("subject"),
        F.lit(fx.BODY_REFUND_ERROR).alias("body"),
    )


def webhook_mails(
    applied: DataFrame,
    payments: DataFrame,
    users: DataFrame,
    reservations: DataFrame,
    details: DataFrame,
    team: str = TEAM_SIGNATURE,
) -> DataFrame:
    """The notices that applied webhooks (``fold_webhooks(...).applied``) call for: confirmations and
    failures to the payer, and a note to the team for every refund that failed. Keys come from ``seq``, so that
    webhooks that are applied again write the same mails."""
    told = applied.filter(F.col("type").isin(fx.TYPE_SUCCEEDED, fx.TYPE_FAILED)).select(
        c.derived_id(F.lit("mail"), "seq").alias("mail_key"), "type", "payment_id", "error_message"
    )
    lines = ticket_lines(reservations, payments, details, told)
    rows = told.join(lines, "payment_id").join(payers_of(payments, users, told), "payment_id")
    paid, name = F.col("type") == fx.TYPE_SUCCEEDED, F.col("name")
    confirmed = c.fill(fx.BODY_CONFIRMED, name=name, lines=F.col("lines"), team=team)
    failed = c.fill(fx.BODY_FAILED, name=name, error=F.col("error_message"), lines=F.col("lines"), team=team)
    mails = rows.select(
        "mail_key",
        "payment_id",
        recipient(name, F.col("email")).alias("recipient"),
        F.when(paid, fx.SUBJECT_CONFIRMED).otherwise(fx.SUBJECT_FAILED).alias("subject"),
        F.when(paid, confirmed).otherwise(failed).alias("body"),
    )
    refunds = applied.filter(F.col("type") == fx.TYPE_REFUND_FAILED).select(
        c.derived_id(F.lit("mail"), "seq").alias("mail_key"), "payment_id"
    )
    return mails.unionByName(refund_error_mails(refunds, keep=("payment_id",)).select(*mails.columns))


def event_updated_mails(
    updated: DataFrame, attendees: DataFrame, team: str = TEAM_SIGNATURE
) -> DataFrame:
    """updated(id, title, description, organizer) and ``confirmed_attendees`` of those events."""
    news = updated.select(F.col("id").alias("event_id"), "title", "description", "organizer")
    organizer = F.when(
        ~c.is_blank("organizer"), c.fill(fx.ORGANIZER_LINE, organizer=F.col("organizer"))
    )
    return attendees.join(news, "event_id").select(
        "event_id",
        "user_id",
        recipient(F.col("full_name"), F.col("email")).alias("recipient"),
        F.lit(fx.SUBJECT_UPDATED).alias("subject"),
        c.fill(
            fx.BODY_UPDATED,
            name=F.col("full_name"),
            title=F.col("title"),
            description=F.col("description"),
            organizer=organizer,
            team=team,
        ).alias("body"),
    )
