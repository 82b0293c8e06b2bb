"""The derived booking views (``boxoffice/sources/derived.py``) as DuckDB CTEs."""

VIEWS = r"""
bk_lines AS (
  SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT),
      date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)) AS reservation_id,
    l_partkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
      AS event_detail_id
  FROM lineitem),
bk_users AS (
  SELECT c_custkey AS id, split_part(c_name, '#', 1) AS firstname,
    split_part(c_name, '#', 2) AS lastname,
    lower(replace(c_name, '#', '.')) || CASE WHEN c_custkey % 17 = 0 THEN '+x' ELSE '' END
      || '@example.com' AS email,
    TIMESTAMP '1994-01-01 00:00:00' AS created_at
  FROM customer),
bk_searches AS (
  SELECT c_custkey AS request_id,
    TIMESTAMP '1995-01-03 08:30:00' + to_days(CAST(c_custkey * 13 % 2300 AS INTEGER)) AS requested_at,
    CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'BRAND#' || (1 + c_custkey % 25)
      WHEN 3 THEN 'Small' WHEN 4 THEN 'ring%brand#' || (c_custkey % 10) WHEN 5 THEN '_e_ w%t'
      WHEN 6 THEN 'z' WHEN 7 THEN 'o% b' WHEN 8 THEN '\_' || (c_custkey % 7) WHEN 9 THEN '_____%'
      ELSE '#1\' || (c_custkey % 10) END AS query,
    CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '1995-02-30'
      ELSE strftime(DATE '1995-01-01' + CAST(c_custkey * 7 % 2400 AS INTEGER), '%Y-%m-%d') END AS "start",
    CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '1996-1-1'
      ELSE strftime(DATE '1995-01-01' + CAST(c_custkey * 7 % 2400 + (c_custkey % 5) * (c_custkey % 5) * 8
        AS INTEGER), '%Y-%m-%d') END AS "end"
  FROM customer),
bk_events AS (
  SELECT p_partkey AS id, p_name AS title, p_type || ' ' || p_brand AS description,
    CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS organizer,
    TIMESTAMP '1994-06-01 00:00:00' AS created_at, p_partkey // 2 AS user_id
  FROM part),
bk_event_details AS (
  SELECT id, TIMESTAMP '1995-01-01 20:00:00' + to_days(CAST(id * 37 % 2400 AS INTEGER))
      AS show_date,
    CAST(CASE WHEN k < 2 THEN p_retailprice WHEN p_size % 5 = 0 THEN 0
      ELSE p_retailprice + 50 END AS DECIMAL(10,2)) AS price,
    5 + p_size % 20 AS number_of_tickets,
    CAST(greatest(0, 5 + p_size % 20 - id % 19) AS INTEGER) AS tickets_remaining,
    CASE k WHEN 0 THEN 'floor' WHEN 1 THEN 'balcony' ELSE 'lounge' END AS ticket_description,
    TIMESTAMP '1994-06-01 00:00:00' AS created_at, p_partkey AS event_id
  FROM (SELECT *, p_partkey * 3 + k AS id FROM part, (VALUES (0), (1), (2)) t(k))),
bk_payments AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
      ELSE 'pi_' || (o_orderkey - CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END) END
      AS payment_intent_id,
    CAST(CASE WHEN o_orderkey % 17 = 3 THEN 0 ELSE o_totalprice END AS DECIMAL(10,2)) AS amount,
    'usd' AS currency,
    CASE WHEN o_orderkey % 11 = 0 THEN 'refunded' WHEN o_orderkey % 13 = 0 THEN 'cancelled'
      WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN 'requires_action'
      ELSE 'refund pending' END AS status,
    o_orderdate + INTERVAL 15 MINUTE AS expires_at, o_orderdate AS created_at,
    o_custkey AS user_id
  FROM orders),
bk_tickets AS (
  SELECT reservation_id AS id, 'guest' || l_suppkey || '@example.com' AS email,
    l_shipdate AS created_at, event_detail_id, l_orderkey AS payment_id
  FROM bk_lines),
bk_reservations AS (
  SELECT t.*, o_custkey AS user_id FROM bk_tickets t JOIN orders ON o_orderkey = payment_id),
bk_outcomes AS (
  SELECT payment_id, action,
    CASE WHEN d IN (4, 9) THEN NULL
      WHEN action = 'refund' THEN CASE WHEN d % 5 = 0 THEN 'failed' WHEN d % 5 = 1
        THEN 'pending' ELSE 'succeeded' END
      WHEN action = 'cancel' THEN 'canceled'
      ELSE CASE d % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'requires_action'
        WHEN 2 THEN CASE WHEN d = 2 THEN 'canceled' ELSE 'requires_payment_method' END
        ELSE CASE WHEN d = 3 THEN 'processing' ELSE 'succeeded' END END END AS status,
    CASE WHEN d = 4 AND payment_id % 20 <> 4 THEN 'card_declined' END AS code,
    CASE WHEN d = 4 THEN 'Your card was declined.' WHEN d = 9 THEN 'connection reset' END
      AS message,
    CASE WHEN d <> 9 THEN 'pi_' || payment_id END AS intent_id,
    CASE WHEN action = 'refund' AND d % 5 = 0 THEN 'lost_or_stolen_card' END AS failure_reason,
    CASE WHEN d = 4 THEN 'gateway' WHEN d = 9 THEN 'other' END AS error,
    CASE WHEN d NOT IN (4, 9) THEN 'secret_' || payment_id END AS client_secret,
    CASE WHEN d % 5 = 1 THEN 'redirect_to_url' END AS next_action
  FROM (SELECT o_orderkey AS payment_id, o_orderkey % 10 AS d, action
    FROM orders, (VALUES ('charge'), ('refund'), ('cancel'), ('retry')) t(action))),
bk_headers AS (
  SELECT o_orderkey AS request_id, o_orderdate AS requested_at, o_custkey AS user_id,
    'login' || o_custkey || '@example.com' AS user_email,
    CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  '
      ELSE 'buyer' || o_orderkey || '@example.com' END AS email,
    CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE 'eur' END
      AS currency,
    'pm_' || o_orderkey AS payment_method_id
  FROM orders),
bk_request_lines AS (
  SELECT l_orderkey AS request_id, reservation_id AS pos,
    CASE WHEN l_linenumber = 6 AND l_suppkey % 10 = 7 THEN -1 - event_detail_id
      ELSE event_detail_id END AS event_detail_id,
    CASE WHEN l_linenumber = 7 AND l_suppkey % 10 = 3 THEN -1
      ELSE 1 + l_linenumber % 3 END AS quantity,
    CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL
      ELSE 'guest' || l_suppkey || '@example.com' END AS email
  FROM bk_lines),
bk_signups AS (
  SELECT c_custkey * 2 + n AS seq, c_custkey % 29 = 3 AS broken,
    CASE WHEN c_custkey % 31 = 4 THEN NULL ELSE 'Ann' END AS firstname,
    'Lee' || c_custkey AS lastname,
    CASE c_custkey % 5 WHEN 0 THEN lower(replace(c_name, '#', '.') || '@example.com')
      WHEN 1 THEN 'new' || c_custkey || '@mail.org'
      WHEN 2 THEN 'a..b[' || c_custkey || ']@x-y.com'
      WHEN 3 THEN 'bad+' || c_custkey || '@x.com'
      ELSE 'team' || c_nationkey || '@club.net' END AS email,
    CASE c_custkey % 7 WHEN 0 THEN 'weak' WHEN 1 THEN 'nouppercase123'
      WHEN 2 THEN 'Has Space 12345' ELSE 'GoodPass' || c_custkey % 10000 || 'xyz!' END
      AS password
  FROM customer, (VALUES (0), (1)) t(n)),
bk_event_bodies AS (
  SELECT p_partkey AS request_id, p_partkey // 2 AS user_id, p_partkey % 37 = 5 AS broken,
    CASE WHEN p_size % 25 = 0 THEN NULL ELSE p_name END AS title, p_type AS description,
    CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END AS organizer,
    p_partkey % 41 = 6 AS no_tickets, sha256('event-' || p_partkey) AS event_id, p_size,
    p_retailprice
  FROM part),
bk_event_good AS (
  SELECT * FROM bk_event_bodies WHERE NOT broken AND title IS NOT NULL AND NOT no_tickets),
bk_event_lines AS (
  SELECT request_id, event_id, pos,
    CASE pos WHEN 0 THEN '1999-02-28 19:30'
      WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN '1999-02-30 19:30' ELSE '1999-03-01 19:30' END
      ELSE CASE WHEN p_size % 4 = 0 THEN '1999-03-02' ELSE '1999-03-02 21:00' END END
      AS show_date,
    CASE pos WHEN 0 THEN 'floor' WHEN 1 THEN 'balcony' ELSE 'lounge' END AS ticket_description,
    CASE pos WHEN 0 THEN CAST(p_retailprice AS DECIMAL(10,2))
      WHEN 1 THEN CAST(p_retailprice / 2 AS DECIMAL(10,2)) ELSE CAST(0 AS DECIMAL(10,2)) END
      AS price,
    CASE pos WHEN 0 THEN p_size WHEN 1 THEN 10 ELSE 5 END AS number_of_tickets
  FROM bk_event_good, (VALUES (0), (1), (2)) t(pos)),
bk_event_lines_judged AS (
  SELECT *, CASE WHEN regexp_matches(show_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{1,2}:[0-9]{2}$')
    THEN TRY_CAST(show_date AS TIMESTAMP) END AS shown
  FROM bk_event_lines),
bk_request_bodies AS (
  SELECT reservation_id AS request_id, l_shipdate AS requested_at, l_suppkey AS user_id,
    'login' || l_suppkey || '@example.com' AS user_email, l_suppkey % 47 = 5 AS broken,
    CASE WHEN l_linenumber = 2 THEN ' ' ELSE 'buyer' || l_orderkey || '@example.com' END
      AS email,
    CASE WHEN l_linenumber = 3 THEN 'eur' WHEN l_linenumber = 4 THEN ' ' END AS currency,
    CASE WHEN l_suppkey % 41 = 0 THEN NULL WHEN l_suppkey % 43 = 0 THEN ''
      ELSE 'pm_' || l_suppkey END AS payment_method_id,
    l_linenumber = 5 AND l_suppkey % 7 = 1 AS no_lines, l_linenumber, l_suppkey,
    event_detail_id
  FROM bk_lines),
bk_request_good AS (
  SELECT * FROM bk_request_bodies
  WHERE NOT broken AND coalesce(payment_method_id, '') <> '' AND NOT no_lines),
bk_webhooks AS (
  SELECT seq, CASE WHEN seq % 499 = 3 THEN 'bad_json' WHEN seq % 1000 = 500 THEN 'oversize' END
      AS broken,
    type, is_refund, cents, pid,
    CASE WHEN is_refund THEN CASE WHEN seq % 83 = 9 THEN NULL ELSE
      'pi_' || pid || CASE WHEN seq % 7 = 0 THEN '_b' ELSE '' END END
      ELSE 'pi_' || pid || CASE WHEN seq % 5 = 0 THEN '_b' ELSE '' END END AS intent_id,
    CASE WHEN NOT is_refund THEN 'pm_' || seq END AS payment_method_id,
    CASE WHEN is_refund AND seq % 3 = 1 THEN 'expired_card' ELSE 'Unknown reason' END
      AS failure_reason,
    CASE WHEN NOT is_refund AND seq % 2 = 0 THEN 'Insufficient funds.' ELSE 'Payment failed.' END
      AS error_message,
    CASE WHEN seq % 61 = 11 THEN NULL WHEN seq % 67 = 12 THEN 'not-an-id'
      WHEN seq % 71 = 13 THEN CAST(-1 - seq AS VARCHAR) ELSE CAST(pid AS VARCHAR) END AS ref
  FROM (SELECT event_id AS seq,
    CASE WHEN event_id % 53 = 7 THEN 'customer.created' ELSE CASE event_type
      WHEN 'purchase' THEN 'payment_intent.succeeded'
      WHEN 'error' THEN 'payment_intent.payment_failed'
      WHEN 'click' THEN 'payment_intent.requires_action'
      WHEN 'signup' THEN 'charge.refunded' ELSE 'refund.failed' END END AS type,
    event_type IN ('signup', 'view') AS is_refund,
    CASE WHEN event_id % 613 = 8 THEN 99999999999 ELSE CAST(round(value * 100) AS BIGINT) END
      AS cents, event_id // 4 * 6 + event_id % 2 AS pid
    FROM events))
"""


def with_views(select: str, more: str = "") -> str:
    """``select`` over the views. ``more`` holds further CTEs; RECURSIVE is always allowed."""
    extra = f",\n{more.strip()}" if more else ""
    return f"WITH RECURSIVE {VIEWS.strip()}{extra}\n{select.strip()}"
