"""Refunds asked for by payers, and what cancelling an event or a ticket type does to its
payments. The gateway is never called: its answers are an input table (see schemas.OUTCOMES)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from boxoffice.functions import columns as c, fixed as fx
from boxoffice.functions.scale import materialize
from boxoffice.operators.aggregates import detail_refund_totals, event_refund_totals
from boxoffice.operators.dml import (
    delete_event_details,
    delete_events,
    refund_and_restore,
    update_payment,
)


def refundable(show_date: Column | str, as_of: datetime | str | Column) -> Column:
    """More than 48 hours away from now, in either direction."""
    show = show_date if isinstance(show_date, Column) else F.col(show_date)
    window = F.expr(f"interval {fx.REFUND_WINDOW_HOURS} hours")
    now = c.clock(as_of)
    return (show > now + window) | (show < now - window)


def _answers(outcomes: DataFrame, action: str) -> DataFrame:
    """The gateway's answers to one action on whole payments."""
    whole = (F.col("action") == action) & F.col("price").isNull()
    return outcomes.filter(whole).select(
        "payment_id",
        F.col("status").alias("g_status"),
        F.col("code").alias("g_code"),
        F.col("message").alias("g_message"),
        F.col("failure_reason").alias("g_reason"),
        F.col("error").alias("g_error"),
    )


# --- a payer asks for a refund -----------------------------------------------------------


@dataclass(frozen=True)
class CustomerRefunds:
    """``summary``: one row per request. ``lines``: one row per refunded reservation."""

    summary: DataFrame
    lines: DataFrame


def customer_refunds(
    requests: DataFrame,
    payments: DataFrame,
    reservations: DataFrame,
    event_details: DataFrame,
    events: DataFrame,
    outcomes: DataFrame,
    as_of: datetime | str,
) -> CustomerRefunds:
    """requests(payment_id, user_id): refund every reservation of a payment that is far enough
    from its show.

    One incomplete reservation, or a payment without an intent, fails the whole request. The
    payment's status is not looked at. The message of an error has one line per failing
    reservation; all of them are the same, so the text is built in the row by repeating the line.
    """
    asked = requests.select("payment_id", "user_id").distinct()
    paid = payments.select(
        F.col("id").alias("payment_id"),
        "user_id",
        "payment_intent_id",
        "amount",
        F.lit(True).alias("known"),
    )
    tiers = event_details.select(
        F.col("id").alias("event_detail_id"), "event_id", "ticket_description", "show_date", "price"
    )
    incomplete = F.col("show_date").isNull() | F.col("price").isNull()
    eligible = ~incomplete & refundable("show_date", as_of)
    # Verdicts need numbers alone; the reservations' own texts are dealt out for the lines only.
    booked = (
        reservations.select("event_detail_id", "payment_id")
        .join(asked, "payment_id", "left_semi")
        .join(tiers, "event_detail_id", "left")
        .select("*", incomplete.alias("bad"), eligible.alias("eligible"))
    )
    # Tickets are summed up per payment before they meet the payment.
    per_payment = booked.groupBy("payment_id").agg(
        F.count("*").alias("tickets"),
        F.count_if("bad").alias("bad"),
        F.count_if("eligible").cast("int").alias("eligible_count"),
        F.sum(F.when(F.col("eligible"), F.col("price"))).cast(fx.MONEY_SUM).alias("sum_price"),
    )
    no_intent = F.coalesce(F.col("payment_intent_id"), F.lit("")) == ""
    # A payment without any reservation has one row that is incomplete.
    tickets = F.coalesce(F.col("tickets"), F.lit(1))
    bad = F.coalesce(F.col("bad"), F.lit(1))
    staged = (
        asked.join(paid, ["payment_id", "user_id"], "left")
        .join(per_payment, "payment_id", "left")
        .withColumn("error_count", F.when(no_intent, tickets).otherwise(bad).cast("int"))
    )
    refund = F.coalesce(F.col("sum_price"), F.lit(0))
    stop = (
        F.when(F.col("known").isNull(), "not_found")
        .when(F.col("error_count") > 0, "error")
        .when(F.col("eligible_count") == 0, "not_eligible")
        .when(refund == 0, "no_amount")
    )
    g_failed = F.col("g_error").isNotNull()
    outcome = F.coalesce(
        F.col("stop"),
        F.when(g_failed, "refund_rejected")
        .when(F.col("g_status") == "failed", "refund_failed")
        .otherwise("ok"),
    )
    reached = F.col("stop").isNull()
    error_line = F.when(no_intent, F.lit(fx.MSG_INTENT_MISSING)).otherwise(fx.MSG_INCOMPLETE)
    summary = (
        staged.withColumn("stop", stop)
        .join(_answers(outcomes, "refund"), "payment_id", "left")
        .withColumn("outcome", outcome)
        .select(
            "payment_id",
            "user_id",
            "outcome",
            "payment_intent_id",
            "amount",
            F.when(F.col("outcome") == "error", F.col("error_count")).alias("error_count"),
            F.when(reached, F.col("eligible_count")).alias("refunded_count"),
            F.when(reached, F.col("sum_price")).alias("refund_total"),
            F.when(
                reached,
                F.when(g_failed | (F.col("g_status") == "failed"), fx.REFUND_FAILED)
                .when(F.col("g_status") == fx.SUCCEEDED, fx.SUCCEEDED)
                .otherwise(fx.REFUND_PENDING),
            ).alias("new_status"),
            F.when(F.col("outcome") == "not_found", fx.MSG_PAYMENT_NOT_FOUND)
            .when(
                F.col("outcome") == "error",
                F.concat(
                    F.lit(fx.MSG_REFUND_ERRORS.rstrip("\n")),
                    F.repeat(F.concat(F.lit("\n"), error_line), F.col("error_count")),
                ),
            )
            .when(F.col("outcome") == "not_eligible", fx.MSG_NOT_ELIGIBLE)
            .when(F.col("outcome") == "no_amount", fx.MSG_NO_AMOUNT)
            .when(g_failed, c.text(fx.MSG_REFUND_INIT_FAILED, F.col("g_message")))
            .when(F.col("g_status") == "failed", c.text(fx.MSG_REFUND_FAILED, F.col("g_reason")))
            .when(F.col("g_status") == fx.SUCCEEDED, fx.MSG_REFUND_NOW)
            .otherwise(fx.MSG_REFUND_INITIATED)
            .alias("message"),
        )
    )
    clean = staged.filter(F.col("known") & (F.col("error_count") == 0)).select(
        "payment_id", "user_id"
    )
    # Titles meet the ticket types, so that reservations are dealt out twice: by ticket type and by payment.
    titles = events.select(F.col("id").alias("event_id"), "title")
    lines = (
        reservations.select(F.col("id").alias("reservation_id"), "event_detail_id", "payment_id")
        .join(tiers.filter(eligible).join(titles, "event_id", "left"), "event_detail_id")
        .join(clean, "payment_id")
        .select(
            "payment_id",
            "user_id",
            "reservation_id",
            "event_detail_id",
            F.col("price").alias("amount"),
            "title",
            "ticket_description",
            "show_date",
        )
    )
    return CustomerRefunds(summary, lines)


def settle_customer_refunds(
    refunds: CustomerRefunds,
    payments: DataFrame,
    reservations: DataFrame,
    event_details: DataFrame,
    as_of: datetime | str,
) -> dict[str, DataFrame]:
    """New table versions after ``customer_refunds``: tickets back, reservations gone, and the
    payment's status set. Once the gateway has been asked, the payment's original amount is
    written back over the decrement."""
    # Two tables come out of each, so they are worked out once. The ids of the reservations serve one table
    # alone and are long, so they are not among what is written.
    back = materialize(refunds.lines.select("event_detail_id", "amount", "payment_id", "user_id"), "refund-lines")
    summary = materialize(refunds.summary, "refunds")
    back = back.withColumn("reservation_id", F.lit(None).cast(reservations.schema["id"].dataType))
    new = refund_and_restore(back, payments, reservations, event_details)
    gone = refund_and_restore(refunds.lines, payments, reservations, event_details)
    new["reservations"] = gone["reservations"]
    asked = summary.filter(F.col("new_status").isNotNull()).select(
        F.lit(0).alias("seq"),
        F.col("payment_id").alias("id"),
        "user_id",
        "amount",
        F.col("new_status").alias("status"),
        "payment_intent_id",
    )
    new["payments"] = update_payment(new["payments"], asked, as_of).drop("updated")
    return new


# --- an owner cancels ---------------------------------------------------------------------


def _with_answer(rows: DataFrame, outcomes: DataFrame, deleted: str) -> DataFrame:
    """Add what the gateway call does to a payment row that has ``status``, ``amount`` and
    ``refund_amount``. A succeeded payment is refunded, any other is cancelled.

    Rows of a ticket price (``price``) have an answer of their own where ``outcomes`` has one for
    that price, else the payment's. An error that is not the gateway's own leaves empty statuses, as
    a failed refund does; the column ``outcome`` tells them apart.
    """
    answer = F.struct(
        F.col("status").alias("g_status"),
        F.col("code").alias("g_code"),
        F.col("message").alias("g_message"),
        F.col("failure_reason").alias("g_reason"),
        F.col("error").alias("g_error"),
    )
    asked = outcomes.filter(F.col("action").isin("refund", "cancel"))
    keys = ["payment_id", "action"]
    whole = asked.filter(F.col("price").isNull()).select(*keys, answer.alias("of_payment"))
    of_tier = asked.filter(F.col("price").isNotNull()).select(*keys, "price", answer.alias("of_tier"))
    declined = F.coalesce(F.col("g_error") == "gateway", F.lit(False))
    failed = F.col("g_error").isNotNull()
    refunds = F.col("action") == "refund"
    log_status = (
        F.when(declined, F.coalesce("g_code", F.lit("")))
        .when(failed, "")
        .when(refunds, F.coalesce("g_status", F.lit("")))
        .otherwise(fx.CANCELLED)
    )
    log_text = (
        F.when(declined, F.col("g_message"))
        .when(failed, None)
        .when(
            refunds,
            F.when(F.col("g_status") == "failed", F.col("g_reason"))
            .when(F.col("g_status") == "pending", fx.LOG_REFUND_PENDING)
            .when(F.col("g_status") == fx.SUCCEEDED, fx.LOG_REFUND_SUCCEEDED),
        )
        .otherwise(deleted)
    )
    new_status = (
        F.when(declined, None)
        .when(failed, "")
        .when(
            refunds,
            F.when(F.col("g_status") == "pending", fx.REFUND_PENDING)
            .when(F.col("g_status") == fx.SUCCEEDED, fx.REFUNDED)
            .otherwise(""),
        )
        .otherwise(fx.CANCELLED)
    )
    outcome = (
        F.when(declined, "gateway_error")
        .when(failed, "error")
        .when(refunds & (F.col("g_status") == "failed"), "refund_failed")
        .when(refunds & (F.col("g_status") == "pending"), "refund_pending")
        .when(refunds, "refunded")
        .otherwise("cancelled")
    )
    action = F.when(F.col("status") == fx.SUCCEEDED, "refund").otherwise("cancel")
    called = rows.withColumn("action", action).join(whole, keys, "left")
    if "price" in rows.columns:
        called = called.join(of_tier, [*keys, "price"], "left").withColumn(
            "of_payment", F.coalesce("of_tier", "of_payment")
        ).drop("of_tier")
    return (
        called.select("*", "of_payment.*")
        .drop("of_payment")
        .withColumns(
            {
                "log_status": log_status,
                "log_description": c.null_if_blank_text(log_text),
                "new_status": new_status,
                "outcome": outcome,
                "failed_action": F.when(
                    declined, F.when(refunds, fx.ACTION_REFUND).otherwise(fx.ACTION_CANCEL)
                ),
                "failed_code": F.when(declined, F.coalesce("g_code", F.lit(""))),
                "failed_message": F.when(declined, F.col("g_message")),
            }
        )
        .drop("g_status", "g_code", "g_message", "g_reason", "g_error")
    )


def event_cancel_plan(
    requests: DataFrame,
    events: DataFrame,
    event_details: DataFrame,
    reservations: DataFrame,
    payments: DataFrame,
    outcomes: DataFrame,
) -> DataFrame:
    """requests(event_id, user_id): one gateway action per payment and ticket price of an event
    its owner cancels. Payments already refunded or cancelled are left out.

    The amount is the tier's total, or 0 for a free payment, which still makes an action. It is
    also what is written to the payment. ``notify`` marks the rows whose payer is told.
    """
    totals = event_refund_totals(requests, events, event_details, reservations, payments)
    live = totals.filter(~F.col("status").isin(fx.REFUNDED, fx.CANCELLED)).withColumn(
        "refund_amount",
        F.when(F.col("amount") == 0, F.lit(0)).otherwise(F.col("ticket_price")).cast(fx.MONEY_SUM),
    )
    planned = _with_answer(live, outcomes, fx.LOG_EVENT_DELETED)
    return planned.withColumn(
        "notify", (F.col("amount") == 0) | F.col("failed_action").isNull()
    ).drop("ticket_price")


def detail_cancel_plan(
    requests: DataFrame,
    events: DataFrame,
    event_details: DataFrame,
    reservations: DataFrame,
    payments: DataFrame,
    users: DataFrame,
    outcomes: DataFrame,
) -> DataFrame:
    """requests(event_detail_id, user_id): one gateway action per payment intent of a ticket
    type its event's owner cancels.

    Payments without an intent are left out; of several payments with one intent the latest
    stands. A free one gets a notice only. The payment is updated under the owner's id, so
    ``update_applies`` only where the owner is the payer.
    """
    totals = detail_refund_totals(
        requests, events, event_details, reservations, payments, users
    ).filter(F.col("payment_intent_id").isNotNull())
    keys = ["event_detail_id", "payment_intent_id"]
    rest = [n for n in totals.columns if n not in keys]
    one_each = (
        totals.repartition("event_detail_id").groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "payment_id")).alias("p"))
        .select(*keys, "p.*")
        .filter(~F.col("status").isin(fx.REFUNDED, fx.CANCELLED))
    )
    asker = requests.select("event_detail_id", F.col("user_id").alias("owner_id")).join(
        event_details.select(F.col("id").alias("event_detail_id"), "event_id"), "event_detail_id"
    ).join(
        events.select(F.col("id").alias("event_id"), F.col("user_id").alias("owner_id")),
        ["event_id", "owner_id"],
        "left_semi",
    ).select("event_detail_id", "owner_id").distinct()
    free = (F.col("amount") == 0) | (F.col("ticket_price") == 0)
    rows = one_each.join(asker, "event_detail_id").withColumn(
        "refund_amount",
        F.when(free, F.lit(0)).otherwise(F.col("ticket_price")).cast(fx.MONEY_SUM),
    )
    acted = _with_answer(rows.filter(~free), outcomes, fx.LOG_DETAIL_DELETED).withColumn(
        "notify", F.col("failed_action").isNull()
    )
    noticed = rows.filter(free).withColumns(
        {"action": F.lit("notice"), "outcome": F.lit("free"), "notify": F.lit(True)}
    )
    hits = F.col("new_status").isNotNull() & (F.col("owner_id") == F.col("payer_user_id"))
    return (
        acted.unionByName(noticed, allowMissingColumns=True)
        .withColumn("update_applies", hits)
        .drop("created_at", "ticket_price")
    )


def cancel_updates(plan: DataFrame, user_column: str = "payer_user_id") -> DataFrame:
    """Requests for ``update_payment`` out of a cancel plan. Where a payment has several rows
    the one with the highest amount is written last."""
    return plan.filter(F.col("new_status").isNotNull()).select(
        F.struct("refund_amount", "new_status").alias("seq"),
        F.col("payment_id").alias("id"),
        F.col(user_column).alias("user_id"),
        F.col("refund_amount").alias("amount"),
        F.col("new_status").alias("status"),
        "payment_intent_id",
    )


def cancel_logs(plan: DataFrame, requests: DataFrame, key: str, as_of) -> DataFrame:
    """Audit rows of a cancel plan; requests(<key>, user_email) name who cancelled. A refund beyond
    the money type writes none."""
    asker = requests.select(key, "user_email").distinct()
    tier = [n for n in ("price", "payment_intent_id") if n in plan.columns]
    return (
        plan.filter(F.col("log_status").isNotNull() & c.money("refund_amount").isNotNull())
        .join(asker, key, "left")
        .select(
            c.derived_id(F.lit("log"), key, "payment_id", *tier).alias("id"),
            F.col("log_status").alias("status"),
            F.col("log_description").alias("description"),
            F.coalesce("payment_intent_id", F.lit("")).alias("payment_intent_id"),
            F.lit(None).cast("string").alias("payment_method_id"),
            c.money("refund_amount").alias("amount"),
            c.clock(as_of).alias("created_at"),
            F.coalesce("user_email", F.lit(fx.UNKNOWN_EMAIL)).alias("user_email"),
            "payment_id",
        )
    )


def cancel_events(
    requests: DataFrame, tables: dict[str, DataFrame], outcomes: DataFrame, as_of: datetime | str
) -> dict[str, DataFrame]:
    """requests(event_id, user_id, user_email): owners delete events. Payments are refunded or
    cancelled first; the events go whatever the gateway said. Returns the new table versions,
    the new audit rows (``payment_logs``), the ``plan`` and the ``deletions`` per request."""
    plan = event_cancel_plan(
        requests,
        tables["events"],
        tables["event_details"],
        tables["reservations"],
        tables["payments"],
        outcomes,
    )
    plan = materialize(plan, "cancel-plan")
    new = delete_events(requests.select(F.col("event_id").alias("id"), "user_id"), tables)
    new["payments"] = update_payment(tables["payments"], cancel_updates(plan), as_of).drop(
        "updated"
    )
    new["payment_logs"] = cancel_logs(plan, requests, "event_id", as_of)
    new["plan"] = plan
    return new


def cancel_event_details(
    requests: DataFrame, tables: dict[str, DataFrame], outcomes: DataFrame, as_of: datetime | str
) -> dict[str, DataFrame]:
    """requests(event_detail_id, event_id, user_id, user_email): the same for ticket types. The
    payments are settled for the event's owner only; the delete asks for the event alone."""
    plan = detail_cancel_plan(
        requests,
        tables["events"],
        tables["event_details"],
        tables["reservations"],
        tables["payments"],
        tables["users"],
        outcomes,
    )
    plan = materialize(plan, "cancel-plan")
    named = requests.select(F.col("event_detail_id").alias("id"), "event_id")
    new = delete_event_details(named, tables)
    updates = cancel_updates(plan, "owner_id")
    new["payments"] = update_payment(tables["payments"], updates, as_of).drop("updated")
    new["payment_logs"] = cancel_logs(plan, requests, "event_detail_id", as_of)
    new["plan"] = plan
    return new
