"""Every registered query. Each runs an operator over whole derived tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxoffice.functions import columns as c
from boxoffice.functions.scale import materialize
from boxoffice.operators import (
    aggregates as agg,
    booking,
    dml,
    inserts,
    lookups,
    outbox,
    search,
    search_batch as batch_search,
    settlement,
    webhook_fold,
)
from boxoffice.session import prepare
from boxoffice.sources import intake, webhooks
from boxoffice.sources.derived import AS_OF, OPENING, Derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CLOCK = datetime.fromisoformat(AS_OF)
ARRIVAL = ["requested_at", "request_id"]


def query(fn: Callable[[Derived], DataFrame]) -> Callable[[Derived], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Derived(prepare(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def with_absent(keys: DataFrame, column: str) -> DataFrame:
    """Two more keys that match nothing."""
    absent = keys.sparkSession.range(-2, 0).select(F.col("id").alias(column))
    return keys.select(column).unionByName(absent)


# --- search and lookups ------------------------------------------------------------


@query
def search_events(d: Derived) -> DataFrame:
    return search.search_events(d.events, d.event_details, CLOCK, "Ring")


@query
def search_events_dates(d: Derived) -> DataFrame:
    return search.search_events(
        d.events, d.event_details, CLOCK, "brand#1%", "1995-01-01", "2001-07-28"
    )


@query
def search_batch(d: Derived) -> DataFrame:
    return batch_search.search_batch(d.searches, d.events, d.event_details, F.col("requested_at"))


@query
def search_batch_rejects(d: Derived) -> DataFrame:
    return batch_search.rejected_searches(d.searches, F.col("requested_at"))


@query
def search_batch_bounds(d: Derived) -> DataFrame:
    read = batch_search.read_searches(d.searches, F.col("requested_at"))
    return read.filter("message is null").select("request_id", "pattern", "first", "last")


@query
def shows_in_date_ranges(d: Derived) -> DataFrame:
    """All shows in a range of each user's own, from a day to the whole programme."""
    ranges = d.customer.selectExpr(
        "c_custkey as request_id",
        "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast(c_custkey * 7 % 2400 as int)) as first",
        "timestamp_ntz'1995-01-01 19:59:00' + make_dt_interval(cast(c_custkey * 7 % 2400 as int) + "
        "case when c_custkey % 500 = 3 then 3000 else cast(c_custkey % 6 as int) - 1 end) as last",
    )
    shows = d.event_details.select(F.col("id").alias("event_detail_id"), "show_date")
    return batch_search.shows_between(ranges, shows).select("request_id", "event_detail_id")


@query
def user_events(d: Derived) -> DataFrame:
    keys = with_absent(d.users.select(F.col("id").alias("user_id")), "user_id")
    return lookups.user_events(keys, d.events).drop("updated_at")


@query
def user_event_by_id(d: Derived) -> DataFrame:
    keys = d.events.selectExpr(
        "id", "user_id + case when id % 4 = 0 then 1 else 0 end as user_id"
    )
    return lookups.user_event_by_id(keys, d.events).drop("updated_at")


@query
def details_by_event(d: Derived) -> DataFrame:
    keys = d.lineitem.select(F.col("l_partkey").alias("event_id"))
    return lookups.details_by_event(d.event_details, keys).drop("updated_at")


@query
def detail_by_id(d: Derived) -> DataFrame:
    keys = with_absent(
        d.lineitem.select(F.col("event_detail_id").alias("id")).distinct(), "id"
    )
    return lookups.detail_by_id(keys, d.event_details).drop("updated_at")


@query
def payment_by_id(d: Derived) -> DataFrame:
    keys = d.payments.selectExpr(
        "id", "user_id + case when id % 5 = 0 then 1 else 0 end as user_id"
    )
    return lookups.payment_by_id(keys, d.payments).drop("updated_at")


@query
def payment_by_id_only(d: Derived) -> DataFrame:
    keys = with_absent(d.lineitem.select(F.col("l_orderkey").alias("id")).distinct(), "id")
    return lookups.payment_by_id_only(keys, d.payments).drop("updated_at")


@query
def user_payments(d: Derived) -> DataFrame:
    keys = with_absent(d.users.select(F.col("id").alias("user_id")), "user_id")
    return lookups.user_payments(keys, d.payments).drop("updated_at")


@query
def multiple_payments(d: Derived) -> DataFrame:
    keys = d.lineitem.select(F.col("l_orderkey").alias("id"))
    return lookups.multiple_payments(d.payments, keys).drop("updated_at")


@query
def payment_by_intent(d: Derived) -> DataFrame:
    keys = d.orders.selectExpr("concat('pi_', o_orderkey) as payment_intent_id")
    return lookups.payment_by_intent(keys, d.payments).drop("updated_at")


@query
def user_reservations(d: Derived) -> DataFrame:
    keys = with_absent(d.users.select(F.col("id").alias("user_id")), "user_id")
    return lookups.user_reservations(keys, d.reservations).drop("updated_at")


@query
def reservation_by_id(d: Derived) -> DataFrame:
    keys = d.reservations.selectExpr(
        "id", "user_id + case when event_detail_id % 4 = 0 then 1 else 0 end as user_id"
    )
    return lookups.reservation_by_id(keys, d.reservations).drop("updated_at")


@query
def reservations_by_payment(d: Derived) -> DataFrame:
    keys = d.payments.selectExpr("user_id", "id as payment_id")
    return lookups.reservations_by_payment(keys, d.reservations).drop("updated_at")


@query
def user_by_email(d: Derived) -> DataFrame:
    keys = d.users.selectExpr("case when id % 3 = 0 then upper(email) else email end as email")
    return lookups.user_by_email(keys, d.users).drop("updated_at")


@query
def user_by_id(d: Derived) -> DataFrame:
    keys = with_absent(d.orders.select(F.col("o_custkey").alias("id")).distinct(), "id")
    return lookups.user_by_id(keys, d.users).drop("updated_at")


@query
def details_with_title(d: Derived) -> DataFrame:
    keys = d.lineitem.select(F.col("event_detail_id").alias("id"))
    return lookups.details_with_title(d.event_details, d.events, keys)


@query
def payment_reservation_details(d: Derived) -> DataFrame:
    keys = d.payments.selectExpr(
        "id as payment_id", "user_id + case when id % 23 = 0 then 1 else 0 end as user_id"
    )
    return agg.payment_reservation_details(
        keys, d.payments, d.tickets, d.event_details, d.events
    )


@query
def events_with_tickets(d: Derived) -> DataFrame:
    return lookups.events_with_tickets(d.events.drop("updated_at"), d.event_details)


@query
def events_with_ticket_lists(d: Derived) -> DataFrame:
    rows = lookups.events_with_tickets(
        d.events.select("id", "user_id", "title"), d.event_details
    )
    listed = F.transform(
        "tickets",
        lambda t: F.concat_ws(
            "|", t["id"], t["price"], t["number_of_tickets"], t["tickets_remaining"]
        ),
    )
    return agg.nest_tickets(rows).select(
        "event_id",
        "user_id",
        "title",
        F.size("tickets").alias("n_tickets"),
        F.array_join(listed, ";").alias("tickets"),
    )


# --- aggregates -----------------------------------------------------------------------


def _owned_events(d: Derived) -> DataFrame:
    """Each event asked for by its owner; one in nine by someone else."""
    return d.events.selectExpr(
        "id as event_id",
        "user_id + case when id % 9 = 0 then 1 else 0 end as user_id",
        "concat('owner', user_id, '@example.com') as user_email",
    )


def _owned_details(d: Derived) -> DataFrame:
    return d.event_details.selectExpr(
        "id as event_detail_id",
        "event_id div 2 + case when id % 9 = 0 then 1 else 0 end as user_id",
        "concat('owner', event_id div 2, '@example.com') as user_email",
    )


@query
def event_refund_totals(d: Derived) -> DataFrame:
    return agg.event_refund_totals(
        _owned_events(d), d.events, d.event_details, d.tickets, d.payments
    )


@query
def detail_refund_totals(d: Derived) -> DataFrame:
    return agg.detail_refund_totals(
        _owned_details(d), d.events, d.event_details, d.tickets, d.payments, d.users
    )


@query
def tickets_per_payment(d: Derived) -> DataFrame:
    return agg.tickets_per_payment(d.tickets)


@query
def confirmed_attendees(d: Derived) -> DataFrame:
    keys = d.events.select(F.col("id").alias("event_id"))
    return agg.confirmed_attendees(keys, d.event_details, d.tickets, d.payments, d.users)


# --- intake and inserts ---------------------------------------------------------------------


@query
def registration_quality(d: Derived) -> DataFrame:
    rows = intake.registrations(d.registration_bodies).rows
    return inserts.check_registrations(rows, d.users)


@query
def registration_rejects(d: Derived) -> DataFrame:
    return intake.registrations(d.registration_bodies).rejects


@query
def create_users(d: Derived) -> DataFrame:
    rows = intake.registrations(d.registration_bodies).rows
    return inserts.create_users(inserts.check_registrations(rows, d.users), AS_OF).drop(
        "updated_at"
    )


@query
def event_intake(d: Derived) -> DataFrame:
    return intake.event_requests(d.event_bodies).rows


@query
def event_intake_rejects(d: Derived) -> DataFrame:
    return intake.event_requests(d.event_bodies).rejects


@query
def create_events(d: Derived) -> DataFrame:
    rows = intake.event_requests(d.event_bodies).rows
    return inserts.create_events(rows, AS_OF).drop("updated_at")


@query
def event_detail_intake(d: Derived) -> DataFrame:
    lines = intake.event_requests(d.event_bodies).lines
    return inserts.create_event_details(lines, AS_OF)[0].drop("updated_at")


@query
def event_detail_rejects(d: Derived) -> DataFrame:
    lines = intake.event_requests(d.event_bodies).lines
    return inserts.create_event_details(lines, AS_OF)[1]


@query
def ticket_intake(d: Derived) -> DataFrame:
    return intake.ticket_requests(d.ticket_bodies).rows


@query
def ticket_intake_rejects(d: Derived) -> DataFrame:
    return intake.ticket_requests(d.ticket_bodies).rejects


@query
def request_intake(d: Derived) -> DataFrame:
    lines = intake.reservation_requests(d.reservation_bodies, "bigint").lines
    return lines.withColumnsRenamed({"email": "line_email", "request_email": "email"}).drop(
        "user_id", "user_email"
    )


@query
def request_rejects(d: Derived) -> DataFrame:
    return intake.reservation_requests(d.reservation_bodies, "bigint").rejects


@query
def create_payments(d: Derived) -> DataFrame:
    priced = d.request_headers.withColumn("total", F.expr("cast(request_id % 1000 as decimal(20,2))"))
    return inserts.create_payments(priced).drop("updated_at", "payment_intent_id")


@query
def payment_log_append(d: Derived) -> DataFrame:
    entries = d.payments.selectExpr(
        "concat('t', id) as log_key",
        "status",
        "case when id % 3 = 0 then '' else concat('note ', id) end as description",
        "payment_intent_id",
        "case when id % 2 = 0 then '' else concat('pm_', id) end as payment_method_id",
        "amount",
        "id as payment_id",
        "case when id % 19 = 0 then -1 else user_id end as user_id",
    )
    return inserts.create_payment_logs(entries, d.users, AS_OF)


# --- updates and deletes ----------------------------------------------------------------------


@query
def reserve_single(d: Derived) -> DataFrame:
    return dml.reserve_tickets(_single_requests(d), d.event_details, ["l_shipdate", "id"])


@query
def reserve_single_sliced(d: Derived) -> DataFrame:
    """The same where no task may sort more than 1,000 rows."""
    return dml.reserve_tickets(_single_requests(d), d.event_details, ["l_shipdate", "id"], 1_000)


@query
def reserve_single_inventory(d: Derived) -> DataFrame:
    done = dml.reserve_tickets(_single_requests(d), d.event_details, ["l_shipdate", "id"])
    taken = done.filter("reserved").select("event_detail_id", F.lit(1).alias("tickets"))
    return dml.take_tickets(d.event_details, taken).drop("updated_at")


def _single_requests(d: Derived) -> DataFrame:
    return d.lineitem.selectExpr(
        "reservation_id as id",
        "l_shipdate",
        "case when l_suppkey % 50 = 7 then -event_detail_id else event_detail_id end "
        "as event_detail_id",
    )


def _cancel_requests(d: Derived) -> DataFrame:
    """Payments to take back: those still waiting; some asked for by the wrong user first."""
    waiting = d.payments.filter("status = 'requires_action'")
    return waiting.select("id", "user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).selectExpr(
        "id * 2 + n as seq",
        "id as payment_id",
        "case when id % 3 = 0 and n = 1 then user_id + 1 when id % 7 = 0 then user_id + 1 "
        "else user_id end as user_id",
    )


@query
def restore_and_delete_details(d: Derived) -> DataFrame:
    new = dml.restore_and_delete_payments(
        _cancel_requests(d), d.payments, d.tickets, d.event_details
    )
    return new["event_details"].drop("updated_at")


@query
def restore_and_delete_payments(d: Derived) -> DataFrame:
    new = dml.restore_and_delete_payments(
        _cancel_requests(d), d.payments, d.tickets, d.event_details
    )
    return new["payments"].drop("updated_at")


@query
def restore_and_delete_reservations(d: Derived) -> DataFrame:
    new = dml.restore_and_delete_payments(
        _cancel_requests(d), d.payments, d.tickets, d.event_details
    )
    return new["reservations"].drop("updated_at")


def _refund_requests(d: Derived) -> DataFrame:
    """One refund per reservation; some name the wrong payer or an unknown ticket type."""
    return d.reservations.selectExpr(
        "case when event_detail_id % 31 = 0 then -event_detail_id else event_detail_id end "
        "as event_detail_id",
        "cast(event_detail_id % 40 as decimal(10,2)) as amount",
        "payment_id",
        "case when event_detail_id % 6 = 1 then user_id + 1 else user_id end as user_id",
        "id as reservation_id",
    )


@query
def refund_and_restore_details(d: Derived) -> DataFrame:
    new = dml.refund_and_restore(_refund_requests(d), d.payments, d.tickets, d.event_details)
    return new["event_details"].drop("updated_at")


@query
def refund_and_restore_payments(d: Derived) -> DataFrame:
    new = dml.refund_and_restore(_refund_requests(d), d.payments, d.tickets, d.event_details)
    return new["payments"].drop("updated_at")


@query
def refund_and_restore_reservations(d: Derived) -> DataFrame:
    new = dml.refund_and_restore(_refund_requests(d), d.payments, d.tickets, d.event_details)
    return new["reservations"].drop("updated_at")


def _event_edits(d: Derived) -> DataFrame:
    """Several edits per event, the last one winning; some are not by the owner."""
    return d.lineitem.selectExpr(
        "reservation_id as seq",
        "l_partkey as id",
        "l_partkey div 2 + case when l_suppkey % 4 = 0 then 1 else 0 end as user_id",
        "concat('title ', reservation_id) as title",
        "concat('about ', l_shipdate) as description",
        "case when l_linenumber % 2 = 0 then '' when l_linenumber = 3 then '  ' "
        "else concat('org ', l_suppkey) end as organizer",
    )


@query
def update_event(d: Derived) -> DataFrame:
    return dml.update_event(d.events, _event_edits(d), AS_OF)


@query
def update_event_detail(d: Derived) -> DataFrame:
    edits = d.lineitem.selectExpr(
        "reservation_id as seq",
        "event_detail_id as id",
        "l_partkey + case when l_suppkey % 4 = 0 then 1 else 0 end as event_id",
        "case when l_suppkey % 6 = 0 then '1999-02-30 10:00' else "
        "date_format(l_shipdate, 'yyyy-MM-dd HH:mm') end as show_date",
        "cast(l_extendedprice as decimal(10,2)) as price",
        "cast(l_quantity as int) as number_of_tickets",
        "concat('tier ', l_linenumber) as ticket_description",
    )
    return dml.update_event_detail(d.event_details, edits, AS_OF)


@query
def update_tickets_remaining(d: Derived) -> DataFrame:
    edits = d.lineitem.selectExpr(
        "reservation_id as seq", "event_detail_id as id", "cast(l_quantity as int) as tickets_remaining"
    )
    return dml.update_tickets_remaining(d.event_details, edits, AS_OF)


@query
def update_payment(d: Derived) -> DataFrame:
    edits = d.reservations.selectExpr(
        "id as seq",
        "payment_id as id",
        "user_id + case when event_detail_id % 3 = 0 then 1 else 0 end as user_id",
        "cast(event_detail_id as decimal(10,2)) as amount",
        "case when event_detail_id % 2 = 0 then 'succeeded' else '' end as status",
        "case when event_detail_id % 5 = 0 then null else concat('pi_n', payment_id) end "
        "as payment_intent_id",
    )
    return dml.update_payment(d.payments, edits, AS_OF)


@query
def update_reservation_email(d: Derived) -> DataFrame:
    edits = d.reservations.selectExpr(
        "payment_id as seq",
        "id",
        "user_id + case when event_detail_id % 3 = 0 then 1 else 0 end as user_id",
        "concat('new', event_detail_id, '@example.com') as email",
    )
    return dml.update_reservation_email(d.reservations, edits, AS_OF)


def _tables(d: Derived) -> dict[str, DataFrame]:
    return {
        "users": d.users,
        "events": d.events,
        "event_details": d.event_details,
        "payments": d.payments,
        "reservations": d.reservations,
    }


def _event_deletes(d: Derived) -> DataFrame:
    """Owners delete the events without an organizer; some requests are not the owner's."""
    return d.events.filter("organizer is null").selectExpr(
        "id", "user_id + case when id % 3 = 0 then 1 else 0 end as user_id"
    )


@query
def delete_event_requests(d: Derived) -> DataFrame:
    return dml.delete_events(_event_deletes(d), _tables(d))["deletions"]


@query
def delete_event_cascade(d: Derived) -> DataFrame:
    return dml.delete_events(_event_deletes(d), _tables(d))["reservations"].drop("updated_at")


@query
def delete_event_left(d: Derived) -> DataFrame:
    return dml.delete_events(_event_deletes(d), _tables(d))["events"].drop("updated_at")


@query
def delete_event_details_left(d: Derived) -> DataFrame:
    return dml.delete_events(_event_deletes(d), _tables(d))["event_details"].drop("updated_at")


def _detail_deletes(d: Derived) -> DataFrame:
    return d.event_details.filter("price = 0 or tickets_remaining = 0").selectExpr(
        "id", "event_id + case when id % 4 = 0 then 1 else 0 end as event_id"
    )


@query
def delete_detail_cascade(d: Derived) -> DataFrame:
    return dml.delete_event_details(_detail_deletes(d), _tables(d))["reservations"].drop("updated_at")


@query
def delete_detail_left(d: Derived) -> DataFrame:
    return dml.delete_event_details(_detail_deletes(d), _tables(d))["event_details"].drop("updated_at")


def _user_deletes(d: Derived) -> dict[str, DataFrame]:
    blocked = d.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("id"))
    return dml.cascade_delete(_tables(d), users=blocked)


@query
def delete_user_cascade(d: Derived) -> DataFrame:
    return _user_deletes(d)["reservations"].drop("updated_at")


@query
def delete_user_events(d: Derived) -> DataFrame:
    return _user_deletes(d)["events"].drop("updated_at")


@query
def delete_user_payments(d: Derived) -> DataFrame:
    return _user_deletes(d)["payments"].drop("updated_at")


# --- booking ------------------------------------------------------------------------------


def _details_with_title(d: Derived) -> DataFrame:
    titles = d.events.select(F.col("id").alias("event_id"), "title")
    return d.event_details.join(titles, "event_id")


@query
def quote_requests(d: Derived) -> DataFrame:
    clocks = d.request_headers.select("request_id", "requested_at")
    lines = d.request_lines.drop("email").join(clocks, "request_id")
    return booking.quote_requests(
        d.request_headers.select("request_id", "requested_at", "user_id"),
        lines,
        _details_with_title(d),
    )


def _opening_sale(d: Derived) -> dict[str, DataFrame]:
    """All requests against the full inventory, before the first show."""
    fresh = d.event_details.withColumns(
        {
            "tickets_remaining": F.col("number_of_tickets"),
            # Two of these are more than the money type holds.
            "price": F.expr("case when id % 97 = 5 then 90000000.00 else price end"),
        }
    )
    # Not broadcast: the titles are many times the size of their compressed file.
    titles = d.events.select(F.col("id").alias("event_id"), "title").hint("merge")
    quotes = booking.quote_requests(
        d.request_headers, d.request_lines, fresh.join(titles, "event_id"), OPENING
    )
    return booking.allocate_requests(quotes, d.request_lines, fresh, ARRIVAL)


@query
def allocate_requests(d: Derived) -> DataFrame:
    return _opening_sale(d)["decisions"].select(
        "request_id", "outcome", "accepted", "tickets", "total", "message"
    )


@query
def allocated_reservations(d: Derived) -> DataFrame:
    return _opening_sale(d)["reservations"].drop("updated_at")


@query
def allocated_payments(d: Derived) -> DataFrame:
    return inserts.create_payments(_opening_sale(d)["winners"]).drop(
        "updated_at", "payment_intent_id"
    )


@query
def allocated_inventory(d: Derived) -> DataFrame:
    return _opening_sale(d)["event_details"].select("id", "event_id", "tickets_remaining")


def _charged(d: Derived) -> DataFrame:
    pending = d.payments.selectExpr(
        "id as payment_id",
        "user_id",
        "concat('login', user_id, '@example.com') as user_email",
        "concat('pm_', id) as payment_method_id",
        "amount as total",
    )
    return booking.post_charge_status(pending, d.outcomes)


@query
def post_charge_status(d: Derived) -> DataFrame:
    return _charged(d)


@query
def post_charge_payments(d: Derived) -> DataFrame:
    new = booking.apply_charges(_charged(d), d.payments, d.tickets, d.event_details, AS_OF)
    return new["payments"]


@query
def post_charge_inventory(d: Derived) -> DataFrame:
    new = booking.apply_charges(_charged(d), d.payments, d.tickets, d.event_details, AS_OF)
    return new["event_details"].select("id", "event_id", "tickets_remaining")


@query
def post_charge_reservations(d: Derived) -> DataFrame:
    new = booking.apply_charges(_charged(d), d.payments, d.tickets, d.event_details, AS_OF)
    return new["reservations"].drop("updated_at")


@query
def post_charge_logs(d: Derived) -> DataFrame:
    return booking.charge_logs(_charged(d), AS_OF)


def _retried(d: Derived) -> DataFrame:
    requests = d.payments.selectExpr(
        "id as payment_id", "user_id + case when id % 6 = 0 then 1 else 0 end as user_id"
    )
    return booking.retry_payments(requests, d.payments, d.outcomes)


@query
def payment_retry(d: Derived) -> DataFrame:
    return _retried(d)


@query
def payment_retry_payments(d: Derived) -> DataFrame:
    return dml.update_payment(d.payments, booking.retry_updates(_retried(d)), AS_OF)


# --- settlement ------------------------------------------------------------------------------


def _customer_refunds(d: Derived) -> settlement.CustomerRefunds:
    requests = d.payments.selectExpr(
        "id as payment_id", "user_id + case when id % 23 = 0 then 1 else 0 end as user_id"
    )
    return settlement.customer_refunds(
        requests, d.payments, d.tickets, d.event_details, d.events, d.outcomes, AS_OF
    )


@query
def customer_refund(d: Derived) -> DataFrame:
    return _customer_refunds(d).summary


@query
def customer_refund_lines(d: Derived) -> DataFrame:
    return _customer_refunds(d).lines


def _settled_refunds(d: Derived) -> dict[str, DataFrame]:
    return settlement.settle_customer_refunds(
        _customer_refunds(d), d.payments, d.tickets, d.event_details, AS_OF
    )


@query
def customer_refund_payments(d: Derived) -> DataFrame:
    return _settled_refunds(d)["payments"]


@query
def customer_refund_reservations(d: Derived) -> DataFrame:
    return _settled_refunds(d)["reservations"].drop("updated_at")


@query
def customer_refund_inventory(d: Derived) -> DataFrame:
    return _settled_refunds(d)["event_details"].select("id", "event_id", "tickets_remaining")


def _event_cancel_plan(d: Derived) -> DataFrame:
    return settlement.event_cancel_plan(
        _owned_events(d), d.events, d.event_details, d.tickets, d.payments, d.tier_outcomes
    )


def _detail_cancel_plan(d: Derived) -> DataFrame:
    return settlement.detail_cancel_plan(
        _owned_details(d), d.events, d.event_details, d.tickets, d.payments, d.users, d.outcomes
    )


@query
def event_cancel_plan(d: Derived) -> DataFrame:
    return _event_cancel_plan(d)


def _cancel_events(d: Derived) -> dict[str, DataFrame]:
    return settlement.cancel_events(_owned_events(d), _tables(d), d.tier_outcomes, AS_OF)


def _cancel_event_details(d: Derived) -> dict[str, DataFrame]:
    requests = _owned_details(d).withColumn("event_id", F.expr("event_detail_id div 3"))
    return settlement.cancel_event_details(requests, _tables(d), d.outcomes, AS_OF)


@query
def event_cancel_payments(d: Derived) -> DataFrame:
    return _cancel_events(d)["payments"]


@query
def event_cancel_logs(d: Derived) -> DataFrame:
    return _cancel_events(d)["payment_logs"]


@query
def event_cancel_reservations(d: Derived) -> DataFrame:
    return _cancel_events(d)["reservations"].drop("updated_at")


@query
def detail_cancel_payments(d: Derived) -> DataFrame:
    return _cancel_event_details(d)["payments"]


@query
def detail_cancel_logs(d: Derived) -> DataFrame:
    return _cancel_event_details(d)["payment_logs"]


@query
def detail_cancel_plan(d: Derived) -> DataFrame:
    return _detail_cancel_plan(d)


# --- webhooks -----------------------------------------------------------------------------------


def _fold(d: Derived) -> webhook_fold.WebhookResult:
    typed = webhooks.parse_webhooks(d.webhooks)
    return webhook_fold.fold_webhooks(typed, d.payments, d.users, AS_OF)


@query
def webhook_fold_payments(d: Derived) -> DataFrame:
    return _fold(d).payments


@query
def webhook_fold_sliced(d: Derived) -> DataFrame:
    """The same where no task may sort more than 50 rows."""
    typed = webhooks.parse_webhooks(d.webhooks)
    return webhook_fold.fold_webhooks(typed, d.payments, d.users, AS_OF, split_rows=50).payments


@query
def webhook_logs(d: Derived) -> DataFrame:
    return _fold(d).logs


@query
def webhook_quarantine(d: Derived) -> DataFrame:
    return _fold(d).quarantine


# --- outbox --------------------------------------------------------------------------------------


def _applied_events(d: Derived) -> DataFrame:
    """Written once: mails read it for the payer, the lines and the mail itself."""
    return materialize(_fold(d).applied.select("seq", "type", "payment_id", "error_message"), "applied")


def _applied(d: Derived, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = _fold(d).applied.filter(F.col("type") == kind)
    applied = materialize(events.select(F.col("seq").alias("mail_key"), "payment_id", "error_message"), "applied")
    lines = outbox.ticket_lines(d.reservations, d.payments, _details_with_title(d), applied)
    return applied, outbox.payers_of(d.payments, d.users, applied), lines


@query
def notify_confirmed(d: Derived) -> DataFrame:
    return outbox.confirmation_mails(*_applied(d, "payment_intent.succeeded"))


@query
def webhook_outbox(d: Derived) -> DataFrame:
    applied = _applied_events(d)
    return outbox.webhook_mails(applied, d.payments, d.users, d.reservations, _details_with_title(d))


@query
def mail_lines(d: Derived) -> DataFrame:
    applied = _fold(d).applied.filter("type = 'payment_intent.succeeded'")
    return outbox.mail_lines(d.reservations, d.payments, _details_with_title(d), applied)


@query
def notify_booked(d: Derived) -> DataFrame:
    charged = _charged(d).filter("notify").withColumn("mail_key", F.col("payment_id"))
    lines = outbox.ticket_lines(d.reservations, d.payments, _details_with_title(d), charged)
    return outbox.confirmation_mails(charged, outbox.bookers_of(charged, d.users), lines)


@query
def notify_payment_failed(d: Derived) -> DataFrame:
    return outbox.failure_mails(*_applied(d, "payment_intent.payment_failed"))


@query
def notify_cancelled(d: Derived) -> DataFrame:
    plan = _event_cancel_plan(d)
    return outbox.event_cancelled_mails(plan, outbox.payers_of(d.payments, d.users, plan))


@query
def notify_detail_cancelled(d: Derived) -> DataFrame:
    plan = _detail_cancel_plan(d)
    return outbox.detail_cancelled_mails(plan, outbox.payers_of(d.payments, d.users, plan))


@query
def notify_refund_error(d: Derived) -> DataFrame:
    failed = _fold(d).applied.filter("type = 'refund.failed'").select(
        F.concat(F.lit("webhook-"), "seq").alias("mail_key")
    )
    refused = (
        _detail_cancel_plan(d)
        .filter("action = 'refund' and outcome in ('gateway_error', 'error')")
        .select(
            F.concat_ws("-", F.lit("detail"), "event_detail_id", "payment_id").alias("mail_key")
        )
    )
    return outbox.refund_error_mails(failed.unionByName(refused))


@query
def notify_event_updated(d: Derived) -> DataFrame:
    updated = dml.update_event(d.events, _event_edits(d), AS_OF).filter("updated")
    keys = updated.select(F.col("id").alias("event_id"))
    people = agg.confirmed_attendees(keys, d.event_details, d.tickets, d.payments, d.users)
    return outbox.event_updated_mails(updated, people)
