"""Quoting, all-or-nothing allocation, and what a charge does to a payment."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from boxoffice.functions import columns as c, fixed as fx
from boxoffice.functions.scale import (
    SPLIT_ROWS,
    materialize,
    running,
    shared_dir,
    slice_hot_keys,
)
from boxoffice.operators.dml import restore_and_delete_payments, take_tickets, update_payment

#: Judging steps in the first plan. Each later one has twice as many, as less and less is open.
STEPS = 3
#: A plan with more would take longer to make than to run.
MOST_STEPS = 24


def quote_requests(
    headers: DataFrame,
    lines: DataFrame,
    details: DataFrame,
    as_of: datetime | str | Column | None = None,
) -> DataFrame:
    """Validate and price whole requests.

    headers(request_id, requested_at, ...), lines(request_id, pos, event_detail_id, quantity,
    and requested_at unless ``as_of`` is given), details(id, title, ticket_description,
    show_date, tickets_remaining, price). Each line is judged alone; the first failing line (by
    ``pos``) names the request's outcome. Otherwise the outcome is ``ok`` with the total.
    """
    clock = F.col("requested_at") if as_of is None else c.clock(as_of)
    tiers = details.select(
        F.col("id").alias("event_detail_id"),
        "title",
        "ticket_description",
        "show_date",
        "tickets_remaining",
        "price",
    )
    lacking = F.col("show_date").isNull()
    code = (
        F.when(F.col("quantity") < 0, "invalid_quantity")
        .when(lacking, "not_found")
        .when(F.col("tickets_remaining") < F.col("quantity"), "insufficient")
        .when(clock > F.col("show_date"), "show_past")
    )
    judged = lines.join(tiers, "event_detail_id", "left").withColumn("code", code)
    failure = F.when(
        F.col("code").isNotNull(),
        F.struct(
            "pos",
            "code",
            "event_detail_id",
            "tickets_remaining",
            "title",
            "ticket_description",
            "show_date",
        ),
    )
    totals = judged.groupBy("request_id").agg(
        F.sum("quantity").alias("tickets"),
        F.sum(F.col("price") * F.col("quantity")).cast(fx.MONEY_SUM).alias("total"),
        F.min(failure).alias("f"),
    )
    empty = F.coalesce(F.col("tickets"), F.lit(0)) == 0
    outcome = F.when(empty, "no_tickets").otherwise(F.coalesce("f.code", F.lit("ok")))
    message = (
        F.when(F.col("outcome") == "no_tickets", fx.MSG_NO_TICKETS)
        .when(
            F.col("outcome") == "not_found",
            c.text(fx.MSG_DETAIL_NOT_FOUND, F.col("f.event_detail_id")),
        )
        .when(
            F.col("outcome") == "insufficient",
            c.text(fx.MSG_INSUFFICIENT, F.col("f.tickets_remaining"), F.col("f.title")),
        )
        .when(
            F.col("outcome") == "show_past",
            c.text(
                fx.MSG_SHOW_PAST, F.col("f.ticket_description"), c.mail_time("f.show_date")
            ),
        )
    )
    return (
        headers.join(totals, "request_id", "left")
        .withColumn("outcome", outcome)
        .withColumn("message", message)
        .withColumn("tickets", F.coalesce("tickets", F.lit(0)))
        .withColumn("total", F.when(F.col("outcome") == "ok", F.col("total")))
        .drop("f")
    )


# --- allocation --------------------------------------------------------------------


def decide_requests(
    lines: DataFrame,
    event_details: DataFrame,
    order: list[str],
    split_rows: int = SPLIT_ROWS,
    rounds: list[int] | None = None,
) -> DataFrame:
    """The requests (``request_id``) that do not fit, all-or-nothing, in arrival order.

    lines(request_id, <order>, event_detail_id, quantity). The result equals a loop over the
    requests in ``order`` in which each takes all of its tickets or none. Steps get there in
    parallel: with every undecided earlier request counted as taken, a request that still fits
    on all its ticket types is in; with none of them counted, one that does not fit on some type
    is out. The earliest undecided request is always decided, so steps end. ``STEPS`` of them make
    the first round and twice as many each later one, so a chain of n requests that wait for each
    other takes about log2(n / ``STEPS``) rounds. After a round what is still needed is written: per ticket
    type its open lines, and the accepted ones between its first and last open line; those before
    are taken off its capacity. ``rounds`` is told the open lines after each round.

    Joins merge: the planner knows tables by the size of their compressed files, and what it would
    broadcast can be many times that in the driver.
    """
    group = dict.fromkeys(["request_id", *order, "event_detail_id"])
    demand = lines.filter(F.col("quantity") > 0).groupBy(*group).agg(
        F.sum("quantity").alias("quantity")
    )
    size = Observation()
    demand = materialize(demand, "demand", size, F.count("*").alias("rows"))
    stock = event_details.select(
        F.col("id").alias("event_detail_id"), F.col("tickets_remaining").alias("capacity")
    )
    # A ticket type whose whole demand fits holds nobody back.
    contested = (
        demand.groupBy("event_detail_id")
        .agg(F.sum("quantity").alias("wanted"))
        .join(stock.hint("merge"), "event_detail_id", "left")
        .withColumn("capacity", F.coalesce("capacity", F.lit(0)))
        .filter(F.col("wanted") > F.col("capacity"))
        .select("event_detail_id", F.col("capacity").cast("long").alias("capacity"))
    )
    state = demand.join(contested.hint("merge"), "event_detail_id").withColumn("verdict", F.lit("open"))
    state = slice_hot_keys(
        state,
        ["event_detail_id"],
        order,
        split_rows,
        demand.select("event_detail_id"),
        size.get["rows"],
    )
    columns = state.columns
    out_path = f"{shared_dir(demand.sparkSession)}/rejected-{uuid.uuid4().hex}"
    arrival, steps = F.struct(*order), STEPS
    while True:
        for _ in range(steps):
            state = _judge(state, order)
        steps = min(2 * steps, MOST_STEPS)
        counts = Observation()
        is_open, is_in = F.col("verdict") == "open", F.col("verdict") == "in"
        judged = materialize(state, "allocation", counts, F.count_if(is_open).alias("undecided"))
        if rounds is not None:
            rounds.append(counts.get["undecided"])
        judged.filter(F.col("verdict") == "out").select("request_id").distinct().write.mode(
            "append"
        ).parquet(out_path)
        if counts.get["undecided"] == 0:
            return demand.sparkSession.read.schema(demand.select("request_id").schema).parquet(
                out_path
            )
        # Only what comes up to a type's last open line can still matter to it, and what is
        # accepted before its first one matters as a sum.
        bounds = judged.filter(is_open).groupBy("event_detail_id").agg(
            F.min(arrival).alias("first_open"), F.max(arrival).alias("last_open")
        )
        live = judged.filter(is_open | is_in).join(bounds.hint("merge"), "event_detail_id")
        early = is_in & (arrival < F.col("first_open"))
        taken = live.filter(early).groupBy("event_detail_id").agg(F.sum("quantity").alias("gone"))
        state = (
            live.filter(~early & (arrival <= F.col("last_open")))
            .join(taken.hint("merge"), "event_detail_id", "left")
            .withColumn("capacity", F.col("capacity") - F.coalesce("gone", F.lit(0)))
            .select(*columns)
        )


def _judge(state: DataFrame, order: list[str]) -> DataFrame:
    """One step: the verdict of each open line's request, which is that of all its lines."""
    is_open = F.col("verdict") == "open"
    seen = running(
        state,
        ["event_detail_id"],
        order,
        sums={
            "taken": F.when(F.col("verdict") == "in", F.col("quantity")).otherwise(0),
            "claimed": F.when(F.col("verdict") != "out", F.col("quantity")).otherwise(0),
        },
    )
    # Steps alternate between ticket types and requests, with one shuffle each. A request has one line
    # for each of its ticket types.
    whole = Window.partitionBy("request_id")
    surely = F.bool_and(F.col("claimed") + F.col("quantity") <= F.col("capacity")).over(whole)
    possibly = F.bool_and(F.col("taken") + F.col("quantity") <= F.col("capacity")).over(whole)
    judged = seen.select(*state.columns, surely.alias("surely"), possibly.alias("possibly"))
    verdict = F.when(is_open & F.col("surely"), "in").when(is_open & ~F.col("possibly"), "out").otherwise(F.col("verdict"))
    return judged.withColumn("verdict", verdict).select(*state.columns)


def allocate_requests(
    quotes: DataFrame,
    lines: DataFrame,
    event_details: DataFrame,
    order: list[str],
    split_rows: int = SPLIT_ROWS,
) -> dict[str, DataFrame]:
    """Allocate the requests that ``quote_requests`` found ok.

    quotes(request_id, requested_at, user_id, user_email, email, currency, total, outcome),
    lines(request_id, pos, event_detail_id, quantity, email). Returns ``decisions`` for all
    quotes, the new ``reservations`` (one per ticket) and ``payments``, and the new version of
    ``event_details``.
    """
    # A total beyond the money type makes no payment, and takes no tickets.
    too_much = (F.col("outcome") == "ok") & c.money("total").isNull()
    quotes = (
        quotes.withColumn("too_much", F.coalesce(too_much, F.lit(False)))
        .withColumn("message", F.when(F.col("too_much"), fx.MSG_PAYMENT_ERROR).otherwise(F.col("message")))
        .withColumn("total", F.when(~F.col("too_much"), F.col("total")))
        .withColumn("outcome", F.when(F.col("too_much"), "payment_error").otherwise(F.col("outcome")))
        .drop("too_much")
    )
    quotes = materialize(quotes, "quotes")
    valid = quotes.filter(F.col("outcome") == "ok")
    asked = lines.select("request_id", "event_detail_id", "quantity").join(
        valid.select(*dict.fromkeys(["request_id", *order])).hint("merge"), "request_id"
    )
    rejected = decide_requests(asked, event_details, order, split_rows).hint("merge")
    sold_out = rejected.withColumn("sold_out", F.lit(True))
    decisions = (
        quotes.join(sold_out, "request_id", "left")
        .withColumn("outcome", F.when(F.col("sold_out"), "sold_out").otherwise(F.col("outcome")))
        .withColumn(
            "message", F.when(F.col("sold_out"), fx.MSG_SOLD_OUT).otherwise(F.col("message"))
        )
        .withColumn("accepted", F.col("outcome") == "ok")
        .drop("sold_out")
    )
    winners = valid.join(rejected, "request_id", "left_anti")
    payment_id = c.derived_id(F.lit("payment"), "request_id")
    won = lines.join(
        winners.select(
            "request_id",
            "requested_at",
            "user_id",
            c.first_not_blank("email", "user_email").alias("request_email"),
        ).hint("merge"),
        "request_id",
    ).filter(F.col("quantity") > 0)
    reservations = won.withColumn(
        "n", F.explode(F.sequence(F.lit(1), F.col("quantity")))
    ).select(
        c.derived_id(F.lit("reservation"), "request_id", "pos", "n").alias("id"),
        c.first_not_blank("email", "request_email").alias("email"),
        F.col("requested_at").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        "event_detail_id",
        "user_id",
        payment_id.alias("payment_id"),
    )
    taken = won.select("event_detail_id", F.col("quantity").alias("tickets"))
    return {
        "decisions": decisions,
        "winners": winners,
        "reservations": reservations,
        "event_details": take_tickets(event_details, taken),
    }


# --- after the charge ---------------------------------------------------------------


def post_charge_status(pending: DataFrame, outcomes: DataFrame) -> DataFrame:
    """pending(payment_id, user_id, user_email, payment_method_id, total) with the gateway's
    answer to its ``charge``: the payment's status, the message for the payer, and the audit row.

    A free booking is not charged. ``removed`` marks a canceled one, whose tickets go back; for
    any other ``update_status`` is written to the payment. ``notify`` asks for a confirmation.
    """
    answers = outcomes.filter(F.col("action") == "charge").select(
        "payment_id",
        F.col("client_secret").alias("g_secret"),
        F.col("next_action").alias("g_next"),
        F.col("status").alias("g_status"),
        F.col("code").alias("g_code"),
        F.col("message").alias("g_message"),
        F.col("intent_id").alias("g_intent"),
        F.col("error").alias("g_error"),
    )
    free = F.col("total") <= 0
    declined = F.col("g_error") == "gateway"
    failed = F.col("g_error").isNotNull()
    status = (
        F.when(free, fx.SUCCEEDED)
        .when(declined, F.coalesce("g_code", F.lit("")))
        .otherwise(F.when(failed, "").otherwise(F.coalesce("g_status", F.lit(""))))
    )
    logged_message = (
        F.when(declined, F.col("g_message"))
        .when(failed | F.col("g_status").isNull(), "")
        .when(F.col("g_status").isin(fx.SUCCEEDED, fx.REQUIRES_ACTION), fx.MSG_PAID)
        .otherwise(fx.MSG_SEE_NEXT_ACTION)
    )
    message = (
        F.when(free, fx.MSG_FREE)
        .when(F.col("status") == fx.REQUIRES_ACTION, fx.MSG_COMPLETE_IN_TIME)
        .when(F.col("status") == fx.CANCELED, fx.MSG_EXPIRED)
        .when(F.col("status") == fx.PROCESSING, fx.MSG_PROCESSING)
        .when(F.col("status") == fx.REQUIRES_PAYMENT_METHOD, fx.MSG_NEW_METHOD)
        .otherwise(F.col("logged_message"))
    )
    heard = ~free & (declined | ~failed)
    # Only a payer who has to act is told how.
    asks = ~free & F.col("g_error").isNull() & (F.col("g_status") == fx.REQUIRES_ACTION)
    return (
        pending.join(answers, "payment_id", "left")
        .withColumn("g_error", F.when(~free, F.col("g_error")))
        .withColumn("status", status)
        .withColumn("logged_message", logged_message)
        .select(
            *pending.columns,
            "status",
            message.alias("message"),
            F.when(F.coalesce(heard, F.lit(False)), F.col("g_intent")).alias("payment_intent_id"),
            F.when(asks, F.col("g_secret")).alias("client_secret"),
            F.when(asks, F.col("g_next")).alias("next_action"),
            F.coalesce(F.col("status") == fx.CANCELED, F.lit(False)).alias("removed"),
            F.coalesce(F.col("status") == fx.SUCCEEDED, F.lit(False)).alias("notify"),
            (~free).alias("logged"),
            F.when(~free, c.null_if_blank_text("logged_message")).alias("log_description"),
        )
    )


def retry_payments(requests: DataFrame, payments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """requests(payment_id, user_id): a new payment method for a payment. The gateway's answer
    to ``retry`` sets the status; amount and intent id are kept. Its client secret and next action
    are handed on."""
    paid = payments.select(
        F.col("id").alias("payment_id"),
        "user_id",
        "payment_intent_id",
        "amount",
        "expires_at",
        F.lit(True).alias("known"),
    )
    answers = outcomes.filter(F.col("action") == "retry").select(
        "payment_id",
        F.nullif("client_secret", F.lit("")).alias("g_secret"),
        F.col("next_action").alias("g_next"),
        F.col("status").alias("g_status"),
        F.col("code").alias("g_code"),
        F.col("message").alias("g_message"),
        F.col("error").alias("g_error"),
    )
    outcome = (
        F.when(F.col("known").isNull(), "not_found")
        .when(F.col("payment_intent_id").isNull(), "no_intent")
        .otherwise("updated")
    )
    done = F.col("outcome") == "updated"
    declined = F.col("g_error") == "gateway"
    failed = F.col("g_error").isNotNull()
    return (
        requests.join(paid, ["payment_id", "user_id"], "left")
        .join(answers, "payment_id", "left")
        .withColumn("outcome", outcome)
        .select(
            "payment_id",
            "user_id",
            "outcome",
            F.when(
                done,
                F.when(declined, F.coalesce("g_code", F.lit("")))
                .when(failed, "error")
                .otherwise(F.coalesce("g_status", F.lit(""))),
            ).alias("status"),
            F.when(F.col("outcome") == "not_found", fx.MSG_PAYMENT_NOT_FOUND)
            .when(F.col("outcome") == "no_intent", fx.MSG_NO_INTENT)
            .when(declined, F.col("g_message"))
            .when(failed, fx.MSG_RETRY_UNKNOWN)
            .otherwise(fx.MSG_RETRY_OK)
            .alias("message"),
            F.when(done, F.col("amount")).alias("amount"),
            F.when(done, F.col("payment_intent_id")).alias("payment_intent_id"),
            F.when(done, F.col("expires_at")).alias("expires_at"),
            F.when(done & ~failed, F.col("g_secret")).alias("client_secret"),
            F.when(done & ~failed, F.col("g_next")).alias("next_action"),
        )
    )


def apply_charges(
    charged: DataFrame,
    payments: DataFrame,
    reservations: DataFrame,
    event_details: DataFrame,
    as_of: datetime | str | Column,
) -> dict[str, DataFrame]:
    """New table versions after ``post_charge_status``: a canceled booking gives its tickets back
    and goes, any other payment gets its status, total and intent id."""
    updates = charged.filter(~F.col("removed")).select(
        F.lit(0).alias("seq"),
        F.col("payment_id").alias("id"),
        "user_id",
        F.col("total").alias("amount"),
        "status",
        "payment_intent_id",
    )
    paid = update_payment(payments, updates, as_of).drop("updated")
    canceled = charged.filter("removed").select(F.lit(0).alias("seq"), "payment_id", "user_id")
    return restore_and_delete_payments(canceled, paid, reservations, event_details)


def charge_logs(charged: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Audit rows of ``post_charge_status``; a free booking writes none, nor does a total beyond the
    money type."""
    return charged.filter(F.col("logged") & c.money("total").isNotNull()).select(
        c.derived_id(F.lit("log-charge"), "payment_id").alias("id"),
        "status",
        F.col("log_description").alias("description"),
        F.coalesce("payment_intent_id", F.lit("")).alias("payment_intent_id"),
        c.null_if_blank_text("payment_method_id").alias("payment_method_id"),
        c.money("total").alias("amount"),
        c.clock(as_of).alias("created_at"),
        "user_email",
        "payment_id",
    )


def retry_updates(retried: DataFrame) -> DataFrame:
    """Requests for ``update_payment`` out of ``retry_payments``."""
    return retried.filter(F.col("outcome") == "updated").select(
        F.lit(0).alias("seq"),
        F.col("payment_id").alias("id"),
        "user_id",
        "amount",
        "status",
        "payment_intent_id",
    )
