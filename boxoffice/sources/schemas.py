"""Declared schemas. Nothing in this package infers one."""

from __future__ import annotations

USERS = (
    "id STRING, firstname STRING, lastname STRING, email STRING, password STRING, "
    "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
EVENTS = (
    "id STRING, title STRING, description STRING, organizer STRING, "
    "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, user_id STRING"
)
EVENT_DETAILS = (
    "id STRING, show_date TIMESTAMP_NTZ, price DECIMAL(10,2), number_of_tickets INT, "
    "tickets_remaining INT, ticket_description STRING, created_at TIMESTAMP_NTZ, "
    "updated_at TIMESTAMP_NTZ, event_id STRING"
)
PAYMENTS = (
    "id STRING, payment_intent_id STRING, amount DECIMAL(10,2), currency STRING, status STRING, "
    "expires_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, user_id STRING"
)
RESERVATIONS = (
    "id STRING, email STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, "
    "event_detail_id STRING, user_id STRING, payment_id STRING"
)
PAYMENT_LOGS = (
    "id STRING, status STRING, description STRING, payment_intent_id STRING, "
    "payment_method_id STRING, amount DECIMAL(10,2), created_at TIMESTAMP_NTZ, "
    "user_email STRING, payment_id STRING"
)
OUTCOMES = (
    "payment_id STRING, action STRING, status STRING, code STRING, message STRING, "
    "intent_id STRING, failure_reason STRING, error STRING, client_secret STRING, "
    "next_action STRING, price DECIMAL(10,2)"
)
TABLES = {
    "users": USERS,
    "events": EVENTS,
    "event_details": EVENT_DETAILS,
    "payments": PAYMENTS,
    "reservations": RESERVATIONS,
    "payment_logs": PAYMENT_LOGS,
    "outcomes": OUTCOMES,
}

# Request bodies, as they arrive in JSON.
REGISTRATION = "firstname STRING, lastname STRING, email STRING, password STRING"
TICKET_REQUEST = (
    "show_date STRING, description STRING, price DECIMAL(10,2), number_of_tickets INT"
)
EVENT_REQUEST = (
    "title STRING, description STRING, organizer STRING, tickets ARRAY<STRUCT<"
    "show_date: STRING, description: STRING, price: DECIMAL(10,2), number_of_tickets: INT>>"
)
RESERVATION_REQUEST = (
    "email STRING, currency STRING, payment_method_id STRING, "
    "event_detail_reservations ARRAY<STRUCT<event_detail_id: {key}, quantity: INT, email: STRING>>"
)
WEBHOOK = (
    "id STRING, type STRING, data STRUCT<object: STRUCT<id: STRING, amount: BIGINT, "
    "amount_refunded: BIGINT, payment_intent: STRING, payment_method: STRING, "
    "failure_reason: STRING, last_payment_error: STRUCT<message: STRING>, "
    "metadata: MAP<STRING, STRING>>>"
)
WEBHOOK_RAW = "seq BIGINT, channel STRING, value STRING"

# Tables the checks run on.
CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
PART = (
    "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE"
)
ORDERS = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
)
LINEITEM = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
)
STREAM_EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING"
)
