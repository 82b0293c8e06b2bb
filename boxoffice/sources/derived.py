"""The booking tables, requests and webhooks derived from the TPC-H-like check tables.

Each view is one projection of one table (reservations need one join), so that a query's cost
is the cost of its operator. The DuckDB text of the same views is in ``duckdb_texts/views.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxoffice.functions.scale import spread
from boxoffice.sources import schemas

AS_OF = "1998-06-15 12:00:00"
OPENING = "1995-01-01 00:00:00"
RESERVATION_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "floor(l_extendedprice * 100 + 0.5), datediff(l_shipdate, date'1970-01-01'))"
)


class Derived:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.root = sf_dir.rstrip("/")

    def _scan(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}.parquet")

    @property
    def customer(self) -> DataFrame:
        return self._scan("customer", schemas.CUSTOMER)

    @property
    def part(self) -> DataFrame:
        return self._scan("part", schemas.PART)

    @property
    def orders(self) -> DataFrame:
        return self._scan("orders", schemas.ORDERS)

    @property
    def lineitem(self) -> DataFrame:
        """Line items with the id of the reservation each one stands for."""
        return self._typed_lines.withColumn("reservation_id", F.expr(RESERVATION_ID))

    @property
    def _typed_lines(self) -> DataFrame:
        return self._scan("lineitem", schemas.LINEITEM).withColumn(
            "event_detail_id",
            F.expr("l_partkey * 3 + case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end"),
        )

    @property
    def stream_events(self) -> DataFrame:
        return self._scan("events", schemas.STREAM_EVENTS)

    # --- the base tables -----------------------------------------------------

    @cached_property
    def users(self) -> DataFrame:
        return self.customer.selectExpr(
            "c_custkey as id",
            "split(c_name, '#')[0] as firstname",
            "split(c_name, '#')[1] as lastname",
            "concat(lower(replace(c_name, '#', '.')), "
            "case when c_custkey % 17 = 0 then '+x' else '' end, '@example.com') as email",
            "concat('hash-', c_custkey) as password",
            "timestamp_ntz'1994-01-01 00:00:00' as created_at",
            "cast(null as timestamp_ntz) as updated_at",
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.part.selectExpr(
            "p_partkey as id",
            "p_name as title",
            "concat(p_type, ' ', p_brand) as description",
            "case when p_size % 10 = 0 then null else p_brand end as organizer",
            "timestamp_ntz'1994-06-01 00:00:00' as created_at",
            "cast(null as timestamp_ntz) as updated_at",
            "p_partkey div 2 as user_id",
        )

    @cached_property
    def event_details(self) -> DataFrame:
        tiers = self.part.select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
        return tiers.selectExpr("*", "p_partkey * 3 + k as id").selectExpr(
            "id",
            "timestamp_ntz'1995-01-01 20:00:00' + "
            "make_dt_interval(cast(id * 37 % 2400 as int)) as show_date",
            "cast(case when k < 2 then p_retailprice when p_size % 5 = 0 then 0 "
            "else p_retailprice + 50 end as decimal(10,2)) as price",
            "5 + p_size % 20 as number_of_tickets",
            "cast(greatest(0, 5 + p_size % 20 - id % 19) as int) as tickets_remaining",
            "case k when 0 then 'floor' when 1 then 'balcony' else 'lounge' end "
            "as ticket_description",
            "timestamp_ntz'1994-06-01 00:00:00' as created_at",
            "cast(null as timestamp_ntz) as updated_at",
            "p_partkey as event_id",
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey as id",
            "case when o_orderpriority = '4-NOT SPECIFIED' then null else concat('pi_', "
            "o_orderkey - case when o_orderkey % 10 = 1 then 1 else 0 end) end "
            "as payment_intent_id",
            "cast(case when o_orderkey % 17 = 3 then 0 else o_totalprice end as decimal(10,2)) "
            "as amount",
            "'usd' as currency",
            "case when o_orderkey % 11 = 0 then 'refunded' when o_orderkey % 13 = 0 then "
            "'cancelled' when o_orderstatus = 'F' then 'succeeded' when o_orderstatus = 'O' "
            "then 'requires_action' else 'refund pending' end as status",
            "o_orderdate + interval 15 minutes as expires_at",
            "o_orderdate as created_at",
            "cast(null as timestamp_ntz) as updated_at",
            "o_custkey as user_id",
        )

    @cached_property
    def tickets(self) -> DataFrame:
        """Reservations without the payer's id, which would need the join with orders."""
        return self._as_tickets(self._typed_lines)

    @staticmethod
    def _as_tickets(lines: DataFrame, *more: str) -> DataFrame:
        return lines.selectExpr(
            f"{RESERVATION_ID} as id",
            "concat('guest', l_suppkey, '@example.com') as email",
            "l_shipdate as created_at",
            "cast(null as timestamp_ntz) as updated_at",
            "event_detail_id",
            *more,
            "l_orderkey as payment_id",
        )

    @cached_property
    def reservations(self) -> DataFrame:
        """The texts are made after the join, so that numbers are shuffled."""
        payers = self.orders.selectExpr("o_orderkey as l_orderkey", "o_custkey as user_id")
        return self._as_tickets(self._typed_lines.join(payers, "l_orderkey"), "user_id")

    # --- inputs that are not base tables ---------------------------------------

    @cached_property
    def outcomes(self) -> DataFrame:
        """What the gateway answered, one row per payment and action."""
        rows = self.orders.selectExpr(
            "o_orderkey as payment_id",
            "o_orderkey % 10 as d",
            "explode(array('charge', 'refund', 'cancel', 'retry')) as action",
        )
        return rows.selectExpr(
            "payment_id",
            "action",
            "case when d in (4, 9) then null "
            "when action = 'refund' then case when d % 5 = 0 then 'failed' when d % 5 = 1 "
            "then 'pending' else 'succeeded' end "
            "when action = 'cancel' then 'canceled' "
            "else case d % 5 when 0 then 'succeeded' when 1 then 'requires_action' "
            "when 2 then case when d = 2 then 'canceled' else 'requires_payment_method' end "
            "else case when d = 3 then 'processing' else 'succeeded' end end end as status",
            "case when d = 4 and payment_id % 20 <> 4 then 'card_declined' end as code",
            "case when d = 4 then 'Your card was declined.' when d = 9 then 'connection reset' "
            "end as message",
            "case when d <> 9 then concat('pi_', payment_id) end as intent_id",
            "case when action = 'refund' and d % 5 = 0 then 'lost_or_stolen_card' end "
            "as failure_reason",
            "case when d = 4 then 'gateway' when d = 9 then 'other' end as error",
            "case when d not in (4, 9) then concat('secret_', payment_id) end as client_secret",
            "case when d % 5 = 1 then 'redirect_to_url' end as next_action",
            "cast(null as decimal(10,2)) as price",
        )

    @cached_property
    def tier_outcomes(self) -> DataFrame:
        """The answers on whole payments, and some on the lounge tickets of a payment alone."""
        lounges = self.event_details.filter("id % 3 = 2").select(
            F.col("id").alias("event_detail_id"), "price"
        )
        paid = self.tickets.filter("payment_id % 3 = 0").select("payment_id", "event_detail_id")
        tiers = paid.join(lounges, "event_detail_id").select("payment_id", "price").distinct()
        own = tiers.selectExpr(
            "payment_id",
            "'refund' as action",
            "case when payment_id % 2 = 0 then 'failed' else 'pending' end as status",
            "cast(null as string) as code",
            "cast(null as string) as message",
            "concat('pi_', payment_id) as intent_id",
            "case when payment_id % 2 = 0 then 'expired_card' end as failure_reason",
            "cast(null as string) as error",
            "cast(null as string) as client_secret",
            "cast(null as string) as next_action",
            "price",
        )
        return self.outcomes.unionByName(own)

    @cached_property
    def request_headers(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey as request_id",
            "o_orderdate as requested_at",
            "o_custkey as user_id",
            "concat('login', o_custkey, '@example.com') as user_email",
            "case o_orderkey % 3 when 0 then null when 1 then '  ' "
            "else concat('buyer', o_orderkey, '@example.com') end as email",
            "case o_orderkey % 4 when 0 then '' when 1 then null when 2 then ' ' else 'eur' end "
            "as currency",
            "concat('pm_', o_orderkey) as payment_method_id",
        )

    @cached_property
    def searches(self) -> DataFrame:
        """A search of every user, each at their own time; some with wildcards, blanks or bad dates."""
        return self.customer.selectExpr(
            "c_custkey as request_id",
            "timestamp_ntz'1995-01-03 08:30:00' + make_dt_interval(cast(c_custkey * 13 % 2300 as int)) "
            "as requested_at",
            "case c_custkey % 11 when 0 then null when 1 then '  ' "
            "when 2 then concat('BRAND#', 1 + c_custkey % 25) when 3 then 'Small' "
            "when 4 then concat('ring%brand#', c_custkey % 10) when 5 then '_e_ w%t' when 6 then 'z' "
            "when 7 then 'o% b' when 8 then concat('\\\\_', c_custkey % 7) when 9 then '_____%' "
            "else concat('#1\\\\', c_custkey % 10) end as query",
            "case c_custkey % 7 when 0 then null when 1 then ' ' when 2 then '1995-02-30' "
            "else date_format(date'1995-01-01' + cast(c_custkey * 7 % 2400 as int), 'yyyy-MM-dd') end as start",
            "case c_custkey % 10 when 0 then '' when 1 then null when 2 then '1996-1-1' "
            "else date_format(date'1995-01-01' + cast(c_custkey * 7 % 2400 + (c_custkey % 5) * "
            "(c_custkey % 5) * 8 as int), 'yyyy-MM-dd') end as end",
        )

    @cached_property
    def request_lines(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "l_orderkey as request_id",
            "reservation_id as pos",
            "case when l_linenumber = 6 and l_suppkey % 10 = 7 then -1 - event_detail_id "
            "else event_detail_id end as event_detail_id",
            "case when l_linenumber = 7 and l_suppkey % 10 = 3 then -1 "
            "else 1 + l_linenumber % 3 end as quantity",
            "case l_suppkey % 3 when 0 then '' when 1 then null "
            "else concat('guest', l_suppkey, '@example.com') end as email",
        )

    # --- raw bodies ---------------------------------------------------------------

    @cached_property
    def registration_bodies(self) -> DataFrame:
        """Two sign-ups per customer; some repeat an address, some are broken."""
        rows = spread(self.customer).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
        return rows.selectExpr(
            "c_custkey * 2 + n as seq",
            "case when c_custkey % 29 = 3 then '{\"firstname\": ' else to_json(named_struct("
            "'firstname', case when c_custkey % 31 = 4 then null else 'Ann' end, "
            "'lastname', concat('Lee', c_custkey), "
            "'email', case when c_custkey % 5 = 0 then lower(concat(replace(c_name, '#', '.'), "
            "'@example.com')) when c_custkey % 5 = 1 then concat('new', c_custkey, '@mail.org') "
            "when c_custkey % 5 = 2 then concat('a..b[', c_custkey, ']@x-y.com') "
            "when c_custkey % 5 = 3 then concat('bad+', c_custkey, '@x.com') "
            "else concat('team', c_nationkey, '@club.net') end, "
            "'password', case c_custkey % 7 when 0 then 'weak' when 1 then 'nouppercase123' "
            "when 2 then 'Has Space 12345' else concat('GoodPass', c_custkey % 10000, 'xyz!') "
            "end)) end as body",
        )

    @cached_property
    def event_bodies(self) -> DataFrame:
        return spread(self.part).selectExpr(
            "p_partkey as request_id",
            "p_partkey div 2 as user_id",
            "case when p_partkey % 37 = 5 then '{\"title\": [' else to_json(named_struct("
            "'title', case when p_size % 25 = 0 then null else p_name end, "
            "'description', p_type, 'organizer', case when p_size % 10 = 0 then '' else p_brand "
            "end, 'tickets', case when p_partkey % 41 = 6 then null else array("
            "named_struct('show_date', '1999-02-28 19:30', 'description', 'floor', "
            "'price', cast(p_retailprice as decimal(10,2)), 'number_of_tickets', p_size), "
            "named_struct('show_date', case when p_size % 3 = 0 then '1999-02-30 19:30' "
            "else '1999-03-01 19:30' end, 'description', 'balcony', "
            "'price', cast(p_retailprice / 2 as decimal(10,2)), 'number_of_tickets', 10), "
            "named_struct('show_date', case when p_size % 4 = 0 then '1999-03-02' "
            "else '1999-03-02 21:00' end, 'description', 'lounge', "
            "'price', cast(0 as decimal(10,2)), 'number_of_tickets', 5)) end)) end as body",
        )

    @cached_property
    def ticket_bodies(self) -> DataFrame:
        """One ticket type per event, each in a body of its own."""
        return self.part.selectExpr(
            "p_partkey as request_id",
            "p_partkey as event_id",
            "case when p_partkey % 43 = 9 then '{\"show_date\": ' else to_json(named_struct("
            "'show_date', case p_size % 4 when 0 then null when 1 then '1999-02-30 10:00' "
            "else '1999-03-01 10:00' end, 'description', p_type, "
            "'price', cast(p_retailprice as decimal(10,2)), "
            "'number_of_tickets', case when p_size % 5 = 0 then 0 else p_size end)) end as body",
        )

    @cached_property
    def reservation_bodies(self) -> DataFrame:
        return spread(self.lineitem).selectExpr(
            "reservation_id as request_id",
            "l_shipdate as requested_at",
            "l_suppkey as user_id",
            "concat('login', l_suppkey, '@example.com') as user_email",
            "case when l_suppkey % 47 = 5 then '{\"email\"' else to_json(named_struct("
            "'email', case when l_linenumber = 2 then ' ' else concat('buyer', l_orderkey, "
            "'@example.com') end, "
            "'currency', case when l_linenumber = 3 then 'eur' when l_linenumber = 4 then ' ' "
            "end, 'payment_method_id', case when l_suppkey % 41 = 0 then null "
            "when l_suppkey % 43 = 0 then '' else concat('pm_', l_suppkey) end, "
            "'event_detail_reservations', case when l_linenumber = 5 and l_suppkey % 7 = 1 "
            "then null else array(named_struct('event_detail_id', event_detail_id, "
            "'quantity', l_linenumber, 'email', concat('guest', l_suppkey, '@example.com')), "
            "named_struct('event_detail_id', event_detail_id + 1, "
            "'quantity', nullif(l_linenumber % 3, 0), 'email', cast(null as string))) "
            "end)) end as body",
        )

    @cached_property
    def webhooks(self) -> DataFrame:
        """Raw gateway events. ``seq`` is the arrival number."""
        rows = spread(self.stream_events).selectExpr(
            "event_id as seq",
            "case when event_id % 53 = 7 then 'customer.created' else case event_type "
            "when 'purchase' then 'payment_intent.succeeded' "
            "when 'error' then 'payment_intent.payment_failed' "
            "when 'click' then 'payment_intent.requires_action' "
            "when 'signup' then 'charge.refunded' else 'refund.failed' end end as type",
            "event_type in ('signup', 'view') as is_refund",
            "case when event_id % 613 = 8 then 99999999999 else cast(round(value * 100) as bigint) "
            "end as cents",
            "event_id div 4 * 6 + event_id % 2 as pid",
        )
        return rows.selectExpr(
            "seq",
            "case when is_refund then 'refund' else 'payment' end as channel",
            "case when seq % 499 = 3 then '{\"type\": \"refund' else "
            "concat(to_json(named_struct('type', type, 'data', named_struct('object', "
            "case when is_refund then named_struct('id', concat('re_', seq), 'amount', cents, "
            "'amount_refunded', cents, 'payment_intent', case when seq % 83 = 9 then null else "
            "concat('pi_', pid, case when seq % 7 = 0 then '_b' else '' end) end, "
            "'payment_method', cast(null as string), "
            "'failure_reason', case when seq % 3 = 0 then '' when seq % 3 = 1 then "
            "'expired_card' end, 'last_payment_error', cast(null as struct<message: string>), "
            "'metadata', cast(null as map<string, string>)) "
            "else named_struct('id', concat('pi_', pid, case when seq % 5 = 0 then '_b' else '' "
            "end), 'amount', cents, 'amount_refunded', cast(null as bigint), "
            "'payment_intent', cast(null as string), 'payment_method', concat('pm_', seq), "
            "'failure_reason', cast(null as string), "
            "'last_payment_error', case when seq % 2 = 0 then "
            "named_struct('message', 'Insufficient funds.') end, "
            "'metadata', case when seq % 61 = 11 then map('note', 'none') else map('payment_id', "
            "case when seq % 67 = 12 then 'not-an-id' when seq % 71 = 13 then cast(-1 - seq as "
            "string) else cast(pid as string) end) end) end))), "
            "case when seq % 1000 = 500 then repeat(' ', 70000) else '' end) end as value",
        )
