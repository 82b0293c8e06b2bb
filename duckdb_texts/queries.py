"""One DuckDB text per registered query, written from the rules and not from the Spark plans."""

from duckdb_texts.views import with_views

ORACLE: dict[str, str] = {}


def sql(name: str, select: str, more: str = "") -> None:
    ORACLE[name] = with_views(select, more)


AS_OF = "TIMESTAMP '1998-06-15 12:00:00'"
ABSENT = "UNION ALL SELECT -1 UNION ALL SELECT -2"

# --- search and lookups ------------------------------------------------------------

# A ticket type is shown in the asked days if the pattern occurs in a text of its event.
SEARCH = """
SELECT n.id AS event_id, n.title, n.description, n.organizer, t.id AS event_detail_id, t.show_date,
  t.price, t.number_of_tickets, t.ticket_description
FROM bk_event_details t, (SELECT *,
    concat_ws(chr(0), title, description, organizer) AS texts FROM bk_events) n
WHERE t.event_id = n.id AND lower(n.texts) LIKE '%{p}%'
  AND t.show_date BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'
"""
sql(
    "search_events",
    SEARCH.format(p="ring", a="1998-06-15 00:00:00", b="1998-06-30 23:59:59"),
)
sql(
    "search_events_dates",
    SEARCH.format(p="brand#1%", a="1995-01-01 00:00:00", b="2001-07-28 23:59:00"),
)
# A backslash stays one before %, _ and itself, and means nothing before anything else.
SEARCHES = r"""
search_days AS (SELECT *, coalesce(trim("start"), '') = '' AS any_start, coalesce(trim("end"), '') = '' AS any_end,
    CASE WHEN regexp_full_match("start", '\d{4}-\d{2}-\d{2}') THEN TRY_CAST("start" AS DATE) END AS day_a,
    CASE WHEN regexp_full_match("end", '\d{4}-\d{2}-\d{2}') THEN TRY_CAST("end" AS DATE) END AS day_b
  FROM bk_searches),
search_read AS (SELECT request_id,
    CASE WHEN coalesce(trim(query), '') = '' THEN '%%'
      ELSE regexp_replace('%' || lower(query) || '%', '(\\[%_\\])|\\(.)', '\1\2', 'gs') END AS pattern,
    CASE WHEN any_start THEN CAST(CAST(requested_at AS DATE) AS TIMESTAMP) ELSE CAST(day_a AS TIMESTAMP) END AS "first",
    CASE WHEN any_end THEN CAST(last_day(requested_at) AS TIMESTAMP) + INTERVAL 86399 SECOND
      ELSE CAST(day_b AS TIMESTAMP) + INTERVAL 1439 MINUTE END AS "last",
    CASE WHEN NOT any_start AND day_a IS NULL THEN 'invalid start show date format'
      WHEN NOT any_end AND day_b IS NULL THEN 'invalid end show date format' END AS message
  FROM search_days)
"""
sql("search_batch_bounds", 'SELECT request_id, pattern, "first", "last" FROM search_read WHERE message IS NULL', SEARCHES)
sql("search_batch_rejects", "SELECT request_id, message FROM search_read WHERE message IS NOT NULL", SEARCHES)
sql(
    "search_batch",
    r"""SELECT r.request_id, t.event_id, n.title, n.description, n.organizer, t.id AS event_detail_id,
      t.show_date, t.price, t.number_of_tickets, t.ticket_description
    FROM search_read r JOIN bk_event_details t ON t.show_date >= r."first" AND t.show_date <= r."last"
    JOIN bk_events n ON n.id = t.event_id
    WHERE r.message IS NULL AND list_bool_or([coalesce(lower(x) LIKE r.pattern ESCAPE '\', false)
      FOR x IN [n.title, n.description, n.organizer]])""",
    SEARCHES,
)
sql(
    "shows_in_date_ranges",
    """SELECT c_custkey AS request_id, t.id AS event_detail_id FROM customer, bk_event_details t
    WHERE date_diff('day', TIMESTAMP '1995-01-01', t.show_date) >= c_custkey * 7 % 2400
      AND t.show_date <= TIMESTAMP '1995-01-01 19:59:00' + to_days(CAST(c_custkey * 7 % 2400
        + CASE WHEN c_custkey % 500 = 3 THEN 3000 ELSE c_custkey % 6 - 1 END AS INTEGER))""",
)
EVENT = "e.title, e.description, e.organizer, e.created_at"
DETAIL = (
    "d.show_date, d.price, d.number_of_tickets, d.tickets_remaining, d.ticket_description, "
    "d.created_at"
)
PAYMENT = "p.amount, p.currency, p.status, p.expires_at, p.created_at"
sql(
    "user_events",
    f"""SELECT k.user_id, e.id, {EVENT}, e.id IS NOT NULL AS found
    FROM (SELECT id AS user_id FROM bk_users {ABSENT}) k
    LEFT JOIN bk_events e ON e.user_id = k.user_id""",
)
sql(
    "user_event_by_id",
    f"""SELECT k.id, k.user_id, {EVENT}, e.id IS NOT NULL AS found
    FROM (SELECT id, user_id + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS user_id FROM bk_events) k
    LEFT JOIN bk_events e ON e.id = k.id AND e.user_id = k.user_id""",
)
sql(
    "details_by_event",
    f"""SELECT d.event_id, d.id, {DETAIL} FROM bk_event_details d
    WHERE d.event_id IN (SELECT l_partkey FROM lineitem)""",
)
sql(
    "detail_by_id",
    f"""SELECT k.id, {DETAIL}, d.event_id, d.id IS NOT NULL AS found
    FROM (SELECT DISTINCT event_detail_id AS id FROM bk_lines {ABSENT}) k
    LEFT JOIN bk_event_details d ON d.id = k.id""",
)
sql(
    "payment_by_id",
    f"""SELECT k.id, k.user_id, p.payment_intent_id, {PAYMENT}, p.id IS NOT NULL AS found
    FROM (SELECT id, user_id + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS user_id
      FROM bk_payments) k
    LEFT JOIN bk_payments p ON p.id = k.id AND p.user_id = k.user_id""",
)
sql(
    "payment_by_id_only",
    f"""SELECT k.id, p.user_id, p.payment_intent_id, {PAYMENT}, p.id IS NOT NULL AS found
    FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem {ABSENT}) k
    LEFT JOIN bk_payments p ON p.id = k.id""",
)
sql(
    "user_payments",
    f"""SELECT k.user_id, p.id, p.payment_intent_id, {PAYMENT}, p.id IS NOT NULL AS found
    FROM (SELECT id AS user_id FROM bk_users {ABSENT}) k
    LEFT JOIN bk_payments p ON p.user_id = k.user_id""",
)
sql(
    "multiple_payments",
    f"""SELECT p.id, p.user_id, p.payment_intent_id, {PAYMENT} FROM bk_payments p
    WHERE p.id IN (SELECT l_orderkey FROM lineitem)""",
)
sql(
    "payment_by_intent",
    f"""SELECT k.payment_intent_id, p.id, {PAYMENT}, p.user_id, p.id IS NOT NULL AS found
    FROM (SELECT 'pi_' || o_orderkey AS payment_intent_id FROM orders) k
    LEFT JOIN (SELECT * FROM bk_payments WHERE payment_intent_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY payment_intent_id ORDER BY created_at, id) = 1) p
    ON p.payment_intent_id = k.payment_intent_id""",
)
sql(
    "user_reservations",
    f"""SELECT k.user_id, r.id, r.email, r.created_at, r.event_detail_id, r.payment_id,
      r.id IS NOT NULL AS found
    FROM (SELECT id AS user_id FROM bk_users {ABSENT}) k
    LEFT JOIN bk_reservations r ON r.user_id = k.user_id""",
)
sql(
    "reservation_by_id",
    """SELECT k.id, k.user_id, r.email, r.created_at, r.event_detail_id, r.payment_id,
      r.id IS NOT NULL AS found
    FROM (SELECT id, user_id + CASE WHEN event_detail_id % 4 = 0 THEN 1 ELSE 0 END AS user_id
      FROM bk_reservations) k
    LEFT JOIN bk_reservations r ON r.id = k.id AND r.user_id = k.user_id""",
)
sql(
    "reservations_by_payment",
    """SELECT k.user_id, k.payment_id, r.id, r.email, r.created_at, r.event_detail_id,
      r.id IS NOT NULL AS found
    FROM (SELECT user_id, id AS payment_id FROM bk_payments) k
    LEFT JOIN bk_reservations r ON r.user_id = k.user_id AND r.payment_id = k.payment_id""",
)
sql(
    "user_by_email",
    """SELECT k.email, u.id, u.firstname, u.lastname, u.created_at, u.id IS NOT NULL AS found
    FROM (SELECT CASE WHEN id % 3 = 0 THEN upper(email) ELSE email END AS email FROM bk_users) k
    LEFT JOIN bk_users u ON u.email = k.email""",
)
sql(
    "user_by_id",
    f"""SELECT k.id, u.firstname, u.lastname, u.email, u.created_at, u.id IS NOT NULL AS found
    FROM (SELECT DISTINCT o_custkey AS id FROM orders {ABSENT}) k
    LEFT JOIN bk_users u ON u.id = k.id""",
)
sql(
    "details_with_title",
    """SELECT ed.id, e.title, ed.ticket_description, ed.show_date, ed.tickets_remaining, ed.price
    FROM bk_event_details ed JOIN bk_events e ON e.id = ed.event_id
    WHERE ed.id IN (SELECT event_detail_id FROM bk_lines)""",
)
# Every ticket of an asked payment with what it was for; a payment without tickets has one bare row.
J3 = """SELECT asked.*, held.* EXCLUDE (payment_id)
    FROM (SELECT id AS payment_id, payment_intent_id, user_id, amount, status FROM bk_payments
      WHERE id % 23 <> 0) asked
    LEFT JOIN (SELECT t.payment_id, t.id AS reservation_id, t.email, t.event_detail_id, kinds.title,
        kinds.ticket_description, kinds.show_date, kinds.price
      FROM bk_tickets t LEFT JOIN (SELECT d.*, (SELECT title FROM bk_events WHERE id = d.event_id) AS title
        FROM bk_event_details d) kinds ON kinds.id = t.event_detail_id) held
      ON held.payment_id = asked.payment_id"""
sql("payment_reservation_details", J3)
sql(
    "events_with_tickets",
    """SELECT e.id AS event_id, e.title, e.description, e.organizer, e.created_at, e.user_id,
      d.id AS event_detail_id, d.show_date, d.price, d.number_of_tickets, d.tickets_remaining,
      d.ticket_description
    FROM bk_events e LEFT JOIN bk_event_details d ON d.event_id = e.id""",
)
sql(
    "events_with_ticket_lists",
    """SELECT e.id AS event_id, e.user_id, e.title, count(d.id) AS n_tickets,
      string_agg(concat_ws('|', d.id, d.price, d.number_of_tickets, d.tickets_remaining), ';'
        ORDER BY d.id) AS tickets
    FROM bk_events e LEFT JOIN bk_event_details d ON d.event_id = e.id GROUP BY ALL""",
)

# --- aggregates -----------------------------------------------------------------------

OWNED = """
owned_events AS (SELECT id AS event_id, user_id + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS user_id,
  'owner' || user_id || '@example.com' AS user_email FROM bk_events),
owned_details AS (SELECT id AS event_detail_id,
  event_id // 2 + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS user_id,
  'owner' || (event_id // 2) || '@example.com' AS user_email FROM bk_event_details),
priced AS (SELECT t.payment_id, d.event_id, d.price, count(*) AS n
  FROM bk_tickets t JOIN bk_event_details d ON d.id = t.event_detail_id GROUP BY ALL),
event_totals AS (
  SELECT s.event_id, s.payment_id, p.payment_intent_id, p.user_id AS payer_user_id, p.amount,
    p.status, (SELECT title FROM bk_events WHERE id = s.event_id) AS title, s.price,
    CAST(s.n * s.price AS DECIMAL(20,2)) AS ticket_price
  FROM priced s JOIN bk_payments p ON p.id = s.payment_id
  WHERE (s.event_id, s.event_id // 2) IN (SELECT (event_id, user_id) FROM owned_events)),
counted AS (SELECT payment_id, event_detail_id, count(*) AS n FROM bk_tickets GROUP BY ALL),
detail_totals AS (
  SELECT d.id AS event_detail_id, p.id AS payment_id, p.payment_intent_id,
    p.user_id AS payer_user_id, p.amount, p.status, p.created_at,
    (SELECT title FROM bk_events WHERE id = d.event_id) AS title, d.ticket_description,
    CAST(s.n * d.price AS DECIMAL(20,2)) AS ticket_price
  FROM counted s JOIN bk_event_details d ON d.id = s.event_detail_id
  JOIN bk_payments p ON p.id = s.payment_id
  WHERE (d.id, d.event_id // 2) IN (SELECT (event_detail_id, user_id) FROM owned_details)
    AND p.user_id IN (SELECT id FROM bk_users))
"""
sql("event_refund_totals", "SELECT * FROM event_totals", OWNED)
sql("detail_refund_totals", "SELECT * FROM detail_totals", OWNED)
sql(
    "tickets_per_payment",
    """SELECT payment_id, event_detail_id, CAST(count(*) AS INTEGER) AS tickets
    FROM bk_tickets GROUP BY 1, 2""",
)
# Who paid, with success, a payment that holds a ticket for the event.
ATTENDEES = """
SELECT e.id AS event_id, u.id AS user_id, u.firstname || ' ' || u.lastname AS full_name, u.email
FROM {events} e, bk_users u
WHERE (e.id, u.id) IN (SELECT (d.event_id, p.user_id) FROM bk_payments p, bk_tickets t, bk_event_details d
  WHERE p.status = 'succeeded' AND t.payment_id = p.id AND d.id = t.event_detail_id)
"""
sql("confirmed_attendees", ATTENDEES.format(events="bk_events"))

# --- intake and inserts ---------------------------------------------------------------------

SIGNUPS = r"""
signup_rows AS (SELECT * FROM bk_signups WHERE NOT broken AND firstname IS NOT NULL),
signup_judged AS (SELECT *, CASE
    WHEN NOT regexp_full_match(email, '[A-Za-z0-9]+([._\-\][A-Za-z0-9]+)*@[A-Za-z0-9]+([\-\.][A-Za-z0-9]+)*\.[A-Za-z]{2,15}')
      THEN 'invalid_email'
    WHEN NOT (strlen(password) BETWEEN 12 AND 20 AND regexp_matches(password, '\p{Lu}')
      AND regexp_matches(password, '\p{Ll}') AND regexp_matches(password, '\p{Nd}')
      AND NOT regexp_matches(password, '\s')) THEN 'weak_password' END AS rule
  FROM signup_rows),
signup_done AS (SELECT seq, firstname, lastname, email, CASE WHEN rule IS NOT NULL THEN rule
    WHEN email IN (SELECT email FROM bk_users) THEN 'email_taken'
    WHEN row_number() OVER (PARTITION BY email, rule IS NULL ORDER BY seq) > 1 THEN 'email_taken'
    ELSE 'accepted' END AS outcome
  FROM signup_judged)
"""
sql(
    "registration_quality",
    """SELECT *, CASE outcome WHEN 'invalid_email' THEN 'invalid email or password'
      WHEN 'weak_password' THEN 'invalid password, password must contain at least 1 upper case letter, 1 lower case letter, 1 digit and must be 12 to 20 characters long'
      WHEN 'email_taken' THEN 'email address is already registered' END AS message
    FROM signup_done""",
    SIGNUPS,
)
BAD_JSON = "'error parsing JSON, please check all required fields are present' AS message"
sql(
    "registration_rejects",
    f"SELECT seq, {BAD_JSON} FROM bk_signups WHERE broken OR firstname IS NULL",
)
sql(
    "create_users",
    f"""SELECT sha256('user-' || email) AS id, firstname, lastname, email, {AS_OF} AS created_at
    FROM signup_done WHERE outcome = 'accepted'""",
    SIGNUPS,
)
SHOW_ERROR = (
    "'error parsing show date ''' || show_date || ''': expected format 2006-01-02 15:04'"
)
sql(
    "event_intake",
    f"""SELECT g.event_id AS id, g.request_id, g.title, g.description,
      nullif(g.organizer, '') AS organizer, g.user_id, b.error
    FROM bk_event_good g LEFT JOIN (
      SELECT request_id, 'encountered errors:' || chr(10) || string_agg({SHOW_ERROR}, chr(10)
        ORDER BY pos) AS error
      FROM bk_event_lines_judged WHERE shown IS NULL GROUP BY 1) b USING (request_id)""",
)
sql(
    "event_intake_rejects",
    f"""SELECT request_id, {BAD_JSON} FROM bk_event_bodies
    WHERE broken OR title IS NULL OR no_tickets""",
)
sql(
    "create_events",
    f"""SELECT event_id AS id, title, description, nullif(organizer, '') AS organizer,
      {AS_OF} AS created_at, user_id FROM bk_event_good""",
)
sql(
    "event_detail_intake",
    f"""SELECT sha256('detail-' || event_id || '-' || pos) AS id, shown AS show_date, price,
      number_of_tickets, number_of_tickets AS tickets_remaining, ticket_description,
      {AS_OF} AS created_at, event_id
    FROM bk_event_lines_judged WHERE shown IS NOT NULL""",
)
sql(
    "event_detail_rejects",
    f"""SELECT event_id, pos, show_date, {SHOW_ERROR} AS message
    FROM bk_event_lines_judged WHERE shown IS NULL""",
)
sql(
    "ticket_intake",
    """SELECT p_partkey AS request_id, p_partkey AS event_id, 0 AS pos,
      CASE WHEN p_size % 4 = 1 THEN '1999-02-30 10:00' ELSE '1999-03-01 10:00' END AS show_date,
      p_type AS ticket_description, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
      p_size AS number_of_tickets
    FROM part WHERE p_partkey % 43 <> 9 AND p_size % 4 <> 0 AND p_size % 5 <> 0""",
)
sql(
    "ticket_intake_rejects",
    f"""SELECT p_partkey AS request_id, {BAD_JSON} FROM part
    WHERE p_partkey % 43 = 9 OR p_size % 4 = 0 OR p_size % 5 = 0""",
)
sql(
    "request_intake",
    """SELECT request_id, requested_at, pos, event_detail_id + pos AS event_detail_id,
      CASE WHEN pos = 0 THEN l_linenumber ELSE l_linenumber % 3 END AS quantity,
      CASE WHEN pos = 0 THEN 'guest' || l_suppkey || '@example.com' END AS line_email,
      CASE WHEN trim(email) = '' THEN user_email ELSE email END AS email,
      CASE WHEN coalesce(trim(currency), '') = '' THEN 'usd' ELSE currency END AS currency,
      payment_method_id
    FROM bk_request_good, (VALUES (0), (1)) t(pos)""",
)
sql(
    "request_rejects",
    f"""SELECT request_id, {BAD_JSON} FROM bk_request_bodies
    WHERE broken OR coalesce(payment_method_id, '') = '' OR no_lines""",
)
sql(
    "create_payments",
    """SELECT sha256('payment-' || request_id) AS id,
      CAST(request_id % 1000 AS DECIMAL(10,2)) AS amount,
      CASE WHEN coalesce(trim(currency), '') = '' THEN 'usd' ELSE currency END AS currency,
      'pending' AS status, requested_at + INTERVAL 15 MINUTE AS expires_at,
      requested_at AS created_at, user_id FROM bk_headers""",
)
sql(
    "payment_log_append",
    f"""SELECT sha256('log-t' || p.id) AS id, status,
      CASE WHEN p.id % 3 <> 0 THEN 'note ' || p.id END AS description,
      coalesce(payment_intent_id, '') AS payment_intent_id,
      CASE WHEN p.id % 2 <> 0 THEN 'pm_' || p.id END AS payment_method_id, amount,
      {AS_OF} AS created_at, coalesce(u.email, 'unknown@example.com') AS user_email,
      p.id AS payment_id
    FROM bk_payments p
    LEFT JOIN bk_users u ON u.id = CASE WHEN p.id % 19 = 0 THEN -1 ELSE p.user_id END""",
)

# --- updates and deletes ----------------------------------------------------------------------

SINGLES = """
singles AS (SELECT reservation_id AS id, l_shipdate,
  CASE WHEN l_suppkey % 50 = 7 THEN -event_detail_id ELSE event_detail_id END AS event_detail_id
  FROM bk_lines),
served AS (SELECT s.*, coalesce(row_number() OVER (PARTITION BY event_detail_id
    ORDER BY l_shipdate, s.id) <= d.tickets_remaining, false) AS reserved
  FROM singles s LEFT JOIN bk_event_details d ON d.id = s.event_detail_id)
"""
DETAIL_REST = "d.show_date, d.price, d.number_of_tickets, d.ticket_description, d.created_at, d.event_id"
sql("reserve_single", "SELECT * FROM served", SINGLES)
sql("reserve_single_sliced", "SELECT * FROM served", SINGLES)
sql(
    "reserve_single_inventory",
    f"""SELECT d.id, {DETAIL_REST}, CAST(d.tickets_remaining - (SELECT count(*) FROM served s
      WHERE reserved AND s.event_detail_id = d.id) AS INTEGER) AS tickets_remaining
    FROM bk_event_details d""",
    SINGLES,
)
TAKE_BACK = """
asks AS (SELECT id * 2 + n AS seq, id AS payment_id, CASE WHEN id % 3 = 0 AND n = 1 THEN user_id + 1
    WHEN id % 7 = 0 THEN user_id + 1 ELSE user_id END AS user_id
  FROM bk_payments, (VALUES (1), (2)) t(n) WHERE status = 'requires_action'),
tagged AS (SELECT a.*, a.user_id = p.user_id AS owns FROM asks a
  JOIN bk_payments p ON p.id = a.payment_id),
effective AS (SELECT * FROM tagged t WHERE NOT EXISTS (SELECT 1 FROM tagged o
  WHERE o.payment_id = t.payment_id AND o.owns AND o.seq < t.seq)),
gone AS (SELECT DISTINCT payment_id FROM effective
  WHERE owns AND payment_id IN (SELECT payment_id FROM bk_tickets))
"""
sql(
    "restore_and_delete_details",
    f"""SELECT d.id, {DETAIL_REST}, CAST(d.tickets_remaining + coalesce(b.n, 0) AS INTEGER)
      AS tickets_remaining
    FROM bk_event_details d LEFT JOIN (SELECT event_detail_id, count(*) AS n
      FROM bk_tickets JOIN effective USING (payment_id) GROUP BY 1) b ON b.event_detail_id = d.id""",
    TAKE_BACK,
)
sql(
    "restore_and_delete_payments",
    "SELECT * FROM bk_payments WHERE id NOT IN (SELECT payment_id FROM gone)",
    TAKE_BACK,
)
sql(
    "restore_and_delete_reservations",
    "SELECT * FROM bk_tickets WHERE payment_id NOT IN (SELECT payment_id FROM gone)",
    TAKE_BACK,
)
REFUNDS = """
asks AS (SELECT CASE WHEN event_detail_id % 31 = 0 THEN -event_detail_id ELSE event_detail_id END
    AS event_detail_id, CAST(event_detail_id % 40 AS DECIMAL(10,2)) AS amount, payment_id,
  CASE WHEN event_detail_id % 6 = 1 THEN user_id + 1 ELSE user_id END AS user_id,
  id AS reservation_id FROM bk_reservations)
"""
sql(
    "refund_and_restore_details",
    f"""SELECT d.id, {DETAIL_REST}, CAST(d.tickets_remaining + (SELECT count(*) FROM asks a
      WHERE a.event_detail_id = d.id) AS INTEGER) AS tickets_remaining FROM bk_event_details d""",
    REFUNDS,
)
sql(
    "refund_and_restore_payments",
    """SELECT p.id, p.user_id, p.payment_intent_id, p.currency, p.status, p.expires_at,
      p.created_at, CAST(p.amount - coalesce(s.off, 0) AS DECIMAL(10,2)) AS amount
    FROM bk_payments p LEFT JOIN (SELECT payment_id, user_id, sum(amount) AS off FROM asks
      GROUP BY 1, 2) s ON s.payment_id = p.id AND s.user_id = p.user_id""",
    REFUNDS,
)
sql(
    "refund_and_restore_reservations",
    """SELECT * FROM bk_tickets WHERE id NOT IN (SELECT reservation_id FROM asks a
      JOIN bk_event_details d ON d.id = a.event_detail_id
      JOIN bk_payments p ON p.id = a.payment_id AND p.user_id = a.user_id)""",
    REFUNDS,
)
EDITS = """
edits AS (SELECT reservation_id AS seq, l_partkey AS id,
  l_partkey // 2 + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS user_id,
  'title ' || reservation_id AS title,
  'about ' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS description,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL WHEN l_linenumber = 3 THEN '  '
    ELSE 'org ' || l_suppkey END AS organizer FROM bk_lines),
edited AS (SELECT e.id, CASE WHEN n.id IS NULL THEN e.title ELSE n.title END AS title,
  CASE WHEN n.id IS NULL THEN e.description ELSE n.description END AS description,
  CASE WHEN n.id IS NULL THEN e.organizer ELSE n.organizer END AS organizer, e.created_at,
  CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '1998-06-15 12:00:00' END AS updated_at, e.user_id,
  n.id IS NOT NULL AS updated
  FROM bk_events e LEFT JOIN (SELECT * FROM edits
    QUALIFY row_number() OVER (PARTITION BY id, user_id ORDER BY seq DESC) = 1) n
  ON n.id = e.id AND n.user_id = e.user_id)
"""
sql("update_event", "SELECT * FROM edited", EDITS)
sql(
    "update_event_detail",
    f"""SELECT d.id, CASE WHEN n.id IS NULL THEN d.show_date ELSE n.show_date END AS show_date,
      CASE WHEN n.id IS NULL THEN d.price ELSE n.price END AS price,
      CASE WHEN n.id IS NULL THEN d.number_of_tickets ELSE n.number_of_tickets END
        AS number_of_tickets, d.tickets_remaining,
      CASE WHEN n.id IS NULL THEN d.ticket_description ELSE n.ticket_description END
        AS ticket_description, d.created_at,
      CASE WHEN n.id IS NOT NULL THEN {AS_OF} END AS updated_at, d.event_id,
      n.id IS NOT NULL AS updated
    FROM bk_event_details d LEFT JOIN (
      SELECT reservation_id AS seq, event_detail_id AS id,
        l_partkey + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS event_id,
        date_trunc('minute', l_shipdate) AS show_date,
        CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
        CAST(l_quantity AS INTEGER) AS number_of_tickets,
        'tier ' || l_linenumber AS ticket_description
      FROM bk_lines WHERE l_suppkey % 6 <> 0) n
    ON n.id = d.id AND n.event_id = d.event_id
    QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY n.seq DESC NULLS LAST) = 1""",
)
sql(
    "update_tickets_remaining",
    f"""SELECT d.id, d.show_date, d.price, d.number_of_tickets,
      CASE WHEN n.id IS NULL THEN d.tickets_remaining ELSE n.remaining END AS tickets_remaining,
      d.ticket_description, d.created_at, CASE WHEN n.id IS NOT NULL THEN {AS_OF} END AS updated_at,
      d.event_id, n.id IS NOT NULL AS updated
    FROM bk_event_details d LEFT JOIN (SELECT event_detail_id AS id, reservation_id AS seq,
        CAST(l_quantity AS INTEGER) AS remaining FROM bk_lines) n ON n.id = d.id
    QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY n.seq DESC NULLS LAST) = 1""",
)
NEW_PAYMENT = f"""SELECT p.id, CASE WHEN n.id IS NULL THEN p.payment_intent_id
        ELSE n.payment_intent_id END AS payment_intent_id,
      CASE WHEN n.id IS NULL THEN p.amount ELSE CAST(n.amount AS DECIMAL(10,2)) END AS amount,
      p.currency, CASE WHEN n.id IS NULL THEN p.status ELSE n.status END AS status, p.expires_at,
      p.created_at, CASE WHEN n.id IS NOT NULL THEN {AS_OF} END AS updated_at, p.user_id,
      n.id IS NOT NULL AS updated
    FROM bk_payments p LEFT JOIN ({{edits}}) n ON n.id = p.id AND n.user_id = p.user_id"""
sql(
    "update_payment",
    NEW_PAYMENT.format(
        edits="""SELECT id AS seq, payment_id AS id,
        user_id + CASE WHEN event_detail_id % 3 = 0 THEN 1 ELSE 0 END AS user_id,
        CAST(event_detail_id AS DECIMAL(10,2)) AS amount,
        CASE WHEN event_detail_id % 2 = 0 THEN 'succeeded' ELSE '' END AS status,
        CASE WHEN event_detail_id % 5 = 0 THEN NULL ELSE 'pi_n' || payment_id END
          AS payment_intent_id
      FROM bk_reservations b QUALIFY row_number() OVER (PARTITION BY payment_id,
        b.user_id + CASE WHEN event_detail_id % 3 = 0 THEN 1 ELSE 0 END ORDER BY b.id DESC) = 1"""
    ),
)
sql(
    "update_reservation_email",
    f"""SELECT id, CASE WHEN event_detail_id % 3 <> 0 THEN 'new' || event_detail_id ||
        '@example.com' ELSE email END AS email, created_at,
      CASE WHEN event_detail_id % 3 <> 0 THEN {AS_OF} END AS updated_at, event_detail_id, user_id,
      payment_id, event_detail_id % 3 <> 0 AS updated FROM bk_reservations""",
)
EVENT_DELETES = """
deletes AS (SELECT id, user_id + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS user_id FROM bk_events
  WHERE organizer IS NULL),
gone AS (SELECT e.id FROM bk_events e JOIN deletes d ON d.id = e.id AND d.user_id = e.user_id)
"""
sql(
    "delete_event_requests",
    """SELECT d.id, d.user_id, CASE WHEN g.id IS NULL THEN 0 ELSE 1 END AS deleted
    FROM deletes d LEFT JOIN gone g ON g.id = d.id""",
    EVENT_DELETES,
)
sql(
    "delete_event_cascade",
    """SELECT r.* FROM bk_reservations r JOIN bk_event_details d ON d.id = r.event_detail_id
    WHERE d.event_id NOT IN (SELECT id FROM gone)""",
    EVENT_DELETES,
)
sql(
    "delete_event_details_left",
    "SELECT * FROM bk_event_details WHERE event_id NOT IN (SELECT id FROM gone)",
    EVENT_DELETES,
)
sql("delete_event_left", "SELECT * FROM bk_events WHERE id NOT IN (SELECT id FROM gone)", EVENT_DELETES)
sql(
    "delete_detail_cascade",
    """SELECT * FROM bk_reservations WHERE event_detail_id NOT IN (SELECT id FROM bk_event_details
      WHERE (price = 0 OR tickets_remaining = 0) AND id % 4 <> 0)""",
)
sql(
    "delete_detail_left",
    """SELECT * FROM bk_event_details
    WHERE NOT ((price = 0 OR tickets_remaining = 0) AND id % 4 <> 0)""",
)
sql(
    "delete_user_cascade",
    """SELECT r.* FROM bk_reservations r JOIN bk_event_details d ON d.id = r.event_detail_id
      JOIN bk_events e ON e.id = d.event_id
    WHERE r.user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
      AND e.user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
BLOCKED = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')"
sql("delete_user_events", f"SELECT * FROM bk_events WHERE user_id NOT IN {BLOCKED}")
sql("delete_user_payments", f"SELECT * FROM bk_payments WHERE user_id NOT IN {BLOCKED}")

# --- booking ------------------------------------------------------------------------------


def quotes(remaining: str, clock: str, price: str = "d.price") -> str:
    return f"""
judged AS (SELECT l.*, CASE WHEN l.quantity < 0 THEN 'invalid_quantity'
    WHEN d.id IS NULL THEN 'not_found' WHEN d.{remaining} < l.quantity THEN 'insufficient'
    WHEN {clock} > d.show_date THEN 'show_past' END AS code, d.{remaining} AS remaining,
    e.title, d.ticket_description, d.show_date, {price} AS price
  FROM bk_request_lines l JOIN bk_headers h USING (request_id)
  LEFT JOIN bk_event_details d ON d.id = l.event_detail_id
  LEFT JOIN bk_events e ON e.id = d.event_id),
first_bad AS (SELECT * FROM judged WHERE code IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY pos) = 1),
sums AS (SELECT request_id, sum(quantity) AS tickets, sum(price * quantity) AS total
  FROM judged GROUP BY 1),
quoted AS (SELECT h.*, coalesce(s.tickets, 0) AS tickets,
    CASE WHEN coalesce(s.tickets, 0) = 0 THEN 'no_tickets' ELSE coalesce(b.code, 'ok') END AS outcome,
    CAST(CASE WHEN coalesce(s.tickets, 0) <> 0 AND b.code IS NULL THEN s.total END
      AS DECIMAL(20,2)) AS total,
    CASE WHEN coalesce(s.tickets, 0) = 0 THEN 'no tickets being reserved'
      WHEN b.code = 'not_found' THEN 'event detail with ID ' || b.event_detail_id || ' not found'
      WHEN b.code = 'insufficient' THEN 'insufficient tickets remaining for one or more requested events: only '
        || b.remaining || ' tickets remaining for ' || b.title
      WHEN b.code = 'show_past' THEN 'error booking ticket, show date is already past: '
        || b.ticket_description || ', show date: ' || strftime(b.show_date, '%Y-%m-%d %H:%M:%S')
        || ' +0000 +0000' END AS message
  FROM bk_headers h LEFT JOIN sums s USING (request_id) LEFT JOIN first_bad b USING (request_id))
"""


sql(
    "quote_requests",
    """SELECT request_id, requested_at, user_id, CAST(tickets AS BIGINT) AS tickets, outcome, total,
      message FROM quoted""",
    quotes("tickets_remaining", "h.requested_at"),
)
# Rounds over all open requests until none is open; a loop in arrival order checks the same
# rule in the tests.
SALE = quotes(
    "number_of_tickets",
    "TIMESTAMP '1995-01-01 00:00:00'",
    "CASE WHEN d.id % 97 = 5 THEN 90000000 ELSE d.price END",
).replace("quoted AS (", "sums_of AS (") + """,
quoted AS (SELECT * REPLACE (
    CASE WHEN outcome = 'ok' AND total > 99999999.99 THEN 'payment_error' ELSE outcome END AS outcome,
    CASE WHEN outcome = 'ok' AND total > 99999999.99 THEN
      'internal database error creating payment' ELSE message END AS message,
    CASE WHEN total <= 99999999.99 THEN total END AS total) FROM sums_of),
demand AS (SELECT q.request_id, q.requested_at, l.event_detail_id, sum(l.quantity) AS quantity,
    any_value(d.number_of_tickets) AS capacity
  FROM quoted q JOIN bk_request_lines l USING (request_id)
  JOIN bk_event_details d ON d.id = l.event_detail_id WHERE q.outcome = 'ok' GROUP BY 1, 2, 3),
rounds AS (
  SELECT 0 AS r, request_id, requested_at, event_detail_id, quantity, capacity, 'open' AS v
  FROM demand
  UNION ALL
  SELECT r + 1, request_id, requested_at, event_detail_id, quantity, capacity,
    CASE WHEN v <> 'open' THEN v
      WHEN bool_and(worst) OVER (PARTITION BY request_id) THEN 'in'
      WHEN NOT bool_and(best) OVER (PARTITION BY request_id) THEN 'out' ELSE 'open' END
  FROM (SELECT *,
      coalesce(sum(CASE WHEN v = 'in' THEN quantity END) OVER w, 0) + quantity <= capacity AS best,
      coalesce(sum(CASE WHEN v <> 'out' THEN quantity END) OVER w, 0) + quantity <= capacity
        AS worst,
      count(*) FILTER (WHERE v = 'open') OVER () AS n_open
    FROM rounds WINDOW w AS (PARTITION BY event_detail_id ORDER BY requested_at, request_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE n_open > 0),
won AS (SELECT DISTINCT request_id FROM rounds
  WHERE r = (SELECT max(r) FROM rounds) AND v = 'in')
"""
sql(
    "allocate_requests",
    """SELECT q.request_id, CAST(q.tickets AS BIGINT) AS tickets, q.total,
      CASE WHEN q.outcome = 'ok' AND w.request_id IS NULL THEN 'sold_out' ELSE q.outcome END
        AS outcome, w.request_id IS NOT NULL AS accepted,
      CASE WHEN q.outcome = 'ok' AND w.request_id IS NULL THEN
        'error reserving ticket, transaction rolled back: sql: no rows in result set'
        ELSE q.message END AS message
    FROM quoted q LEFT JOIN won w USING (request_id)""",
    SALE,
)
sql(
    "allocated_reservations",
    """SELECT sha256('reservation-' || l.request_id || '-' || l.pos || '-' || n) AS id,
      CASE WHEN coalesce(trim(l.email), '') <> '' THEN l.email
        WHEN coalesce(trim(q.email), '') <> '' THEN q.email ELSE q.user_email END AS email,
      q.requested_at AS created_at, l.event_detail_id, q.user_id,
      sha256('payment-' || l.request_id) AS payment_id
    FROM quoted q JOIN won USING (request_id) JOIN bk_request_lines l USING (request_id),
      (VALUES (1), (2), (3)) t(n) WHERE n <= l.quantity""",
    SALE,
)
sql(
    "allocated_payments",
    """SELECT sha256('payment-' || request_id) AS id, CAST(total AS DECIMAL(10,2)) AS amount,
      CASE WHEN coalesce(trim(currency), '') = '' THEN 'usd' ELSE currency END AS currency,
      'pending' AS status, requested_at + INTERVAL 15 MINUTE AS expires_at,
      requested_at AS created_at, user_id FROM quoted JOIN won USING (request_id)""",
    SALE,
)
sql(
    "allocated_inventory",
    """SELECT d.id, d.event_id, CAST(d.number_of_tickets - coalesce(t.n, 0) AS INTEGER)
      AS tickets_remaining
    FROM bk_event_details d LEFT JOIN (SELECT event_detail_id, sum(quantity) AS n FROM demand
      JOIN won USING (request_id) GROUP BY 1) t ON t.event_detail_id = d.id""",
    SALE,
)
CHARGED = """
charged AS (SELECT payment_id, user_id, user_email, payment_method_id, total, status,
      CASE WHEN free THEN 'free reservation successful'
        WHEN status = 'requires_action' THEN 'complete payment within next 15 minutes'
        WHEN status = 'canceled' THEN 'payment expired, please rebook your tickets'
        WHEN status = 'processing' THEN 'payment processing, we''ll send you an email once payment succeeded'
        WHEN status = 'requires_payment_method' THEN 'please submit new payment method'
        ELSE logged_message END AS message,
      CASE WHEN NOT free AND coalesce(error, '') <> 'other' THEN intent_id END AS payment_intent_id,
      CASE WHEN NOT free AND error IS NULL AND g_status = 'requires_action' THEN client_secret END
        AS client_secret,
      CASE WHEN NOT free AND error IS NULL AND g_status = 'requires_action' THEN next_action END
        AS next_action,
      status = 'canceled' AS removed, status = 'succeeded' AS notify, NOT free AS logged,
      CASE WHEN NOT free THEN nullif(logged_message, '') END AS log_description
    FROM (SELECT p.id AS payment_id, p.user_id, 'login' || p.user_id || '@example.com' AS user_email,
        'pm_' || p.id AS payment_method_id, p.amount AS total, p.amount = 0 AS free, o.error,
        o.intent_id, o.client_secret, o.next_action, o.status AS g_status,
        CASE WHEN p.amount = 0 THEN 'succeeded' WHEN o.error = 'gateway' THEN coalesce(o.code, '')
          WHEN o.error = 'other' THEN '' ELSE o.status END AS status,
        CASE WHEN o.error = 'gateway' THEN o.message WHEN o.error = 'other' THEN ''
          WHEN o.status IN ('succeeded', 'requires_action') THEN 'payment successful'
          ELSE 'please refer to next action and status' END AS logged_message
      FROM bk_payments p JOIN bk_outcomes o ON o.payment_id = p.id AND o.action = 'charge'))
"""
sql("post_charge_status", "SELECT * FROM charged", CHARGED)
sql(
    "post_charge_payments",
    f"""SELECT p.id, c.payment_intent_id, p.amount, p.currency, c.status, p.expires_at, p.created_at,
      {AS_OF} AS updated_at, p.user_id
    FROM bk_payments p JOIN charged c ON c.payment_id = p.id WHERE NOT c.removed
    UNION ALL
    SELECT p.id, p.payment_intent_id, p.amount, p.currency, p.status, p.expires_at, p.created_at,
      CAST(NULL AS TIMESTAMP), p.user_id
    FROM bk_payments p JOIN charged c ON c.payment_id = p.id
    WHERE c.removed AND p.id NOT IN (SELECT payment_id FROM bk_tickets)""",
    CHARGED,
)
sql(
    "post_charge_inventory",
    """SELECT d.id, d.event_id, CAST(d.tickets_remaining + coalesce(b.n, 0) AS INTEGER)
      AS tickets_remaining
    FROM bk_event_details d LEFT JOIN (SELECT event_detail_id, count(*) AS n FROM bk_tickets
      JOIN charged USING (payment_id) WHERE removed GROUP BY 1) b ON b.event_detail_id = d.id""",
    CHARGED,
)
sql(
    "post_charge_reservations",
    """SELECT * FROM bk_tickets WHERE payment_id NOT IN (SELECT payment_id FROM charged
      WHERE removed)""",
    CHARGED,
)
sql(
    "post_charge_logs",
    f"""SELECT sha256('log-charge-' || payment_id) AS id, status, log_description AS description,
      coalesce(payment_intent_id, '') AS payment_intent_id, payment_method_id, total AS amount,
      {AS_OF} AS created_at, user_email, payment_id FROM charged WHERE logged""",
    CHARGED,
)
RETRIED = """
retried AS (SELECT payment_id, user_id, outcome,
      CASE WHEN outcome = 'updated' THEN CASE WHEN error = 'gateway' THEN coalesce(code, '')
        WHEN error = 'other' THEN 'error' ELSE g_status END END AS status,
      CASE outcome WHEN 'not_found' THEN 'payment not found'
        WHEN 'no_intent' THEN 'payment record has no linked payment intent'
        ELSE CASE WHEN error = 'gateway' THEN g_message
          WHEN error = 'other' THEN 'an unknown error occurred with payment update'
          ELSE 'payment updated' END END AS message,
      CASE WHEN outcome = 'updated' THEN amount END AS amount,
      CASE WHEN outcome = 'updated' THEN payment_intent_id END AS payment_intent_id,
      CASE WHEN outcome = 'updated' THEN expires_at END AS expires_at,
      CASE WHEN outcome = 'updated' AND error IS NULL THEN client_secret END AS client_secret,
      CASE WHEN outcome = 'updated' AND error IS NULL THEN next_action END AS next_action
    FROM (SELECT id AS payment_id, p.user_id + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS user_id,
        CASE WHEN id % 6 = 0 THEN 'not_found' WHEN payment_intent_id IS NULL THEN 'no_intent'
          ELSE 'updated' END AS outcome, o.status AS g_status, o.code, o.message AS g_message,
        o.error, amount, payment_intent_id, expires_at, o.client_secret, o.next_action
      FROM bk_payments p JOIN bk_outcomes o ON o.payment_id = p.id AND o.action = 'retry'))
"""
sql("payment_retry", "SELECT * FROM retried", RETRIED)
sql(
    "payment_retry_payments",
    NEW_PAYMENT.format(
        edits="""SELECT payment_id AS id, user_id, amount, status, payment_intent_id FROM retried
        WHERE outcome = 'updated'"""
    ),
    RETRIED,
)

# --- settlement ------------------------------------------------------------------------------

REFUND = f"""
asked AS (SELECT id AS payment_id, user_id + CASE WHEN id % 23 = 0 THEN 1 ELSE 0 END AS user_id
  FROM bk_payments),
detail_rows AS ({J3}),
judged AS (SELECT *, payment_intent_id IS NULL OR reservation_id IS NULL OR show_date IS NULL
    OR price IS NULL AS bad,
  payment_intent_id IS NOT NULL AND reservation_id IS NOT NULL AND show_date IS NOT NULL
    AND price IS NOT NULL AND abs(epoch(show_date) - epoch({AS_OF})) > 48 * 3600 AS eligible
  FROM detail_rows),
grouped AS (SELECT payment_id, user_id, any_value(payment_intent_id) AS payment_intent_id,
  any_value(amount) AS amount, CAST(count(*) FILTER (WHERE bad) AS INTEGER) AS n_bad,
  CAST(count(*) FILTER (WHERE eligible) AS INTEGER) AS n_ok,
  CAST(sum(price) FILTER (WHERE eligible) AS DECIMAL(20,2)) AS total
  FROM judged GROUP BY 1, 2),
staged AS (SELECT a.payment_id, a.user_id, g.payment_intent_id, g.amount, g.n_bad, g.n_ok, g.total,
  o.status AS g_status, o.message AS g_message, o.failure_reason, o.error,
  CASE WHEN g.payment_id IS NULL THEN 'not_found' WHEN n_bad > 0 THEN 'error'
    WHEN n_ok = 0 THEN 'not_eligible' WHEN total = 0 THEN 'no_amount' END AS stop
  FROM asked a LEFT JOIN grouped g USING (payment_id, user_id)
  JOIN bk_outcomes o ON o.payment_id = a.payment_id AND o.action = 'refund'),
refunds AS (SELECT *, coalesce(stop, CASE WHEN error IS NOT NULL THEN 'refund_rejected'
    WHEN g_status = 'failed' THEN 'refund_failed' ELSE 'ok' END) AS outcome,
  CASE WHEN stop IS NULL THEN CASE WHEN error IS NOT NULL OR g_status = 'failed' THEN 'refund_failed'
    WHEN g_status = 'succeeded' THEN 'succeeded' ELSE 'refund pending' END END AS new_status
  FROM staged)
"""
sql(
    "customer_refund",
    """SELECT payment_id, user_id, outcome, payment_intent_id, amount,
      CASE WHEN outcome = 'error' THEN n_bad END AS error_count,
      CASE WHEN stop IS NULL THEN n_ok END AS refunded_count,
      CASE WHEN stop IS NULL THEN total END AS refund_total, new_status,
      CASE outcome WHEN 'not_found' THEN 'payment not found'
        WHEN 'error' THEN 'one or more errors occurred during reservation filtering:'
          || repeat(chr(10) || CASE WHEN payment_intent_id IS NULL
            THEN 'payment intent ID is missing' ELSE 'incomplete reservation details found' END, n_bad)
        WHEN 'not_eligible' THEN 'no reservations were eligible for refund'
        WHEN 'no_amount' THEN 'no refund amount calculated after processing reservations'
        WHEN 'refund_rejected' THEN 'Refund initiation failed: ' || g_message
        WHEN 'refund_failed' THEN 'Refund failed: ' || failure_reason
        ELSE CASE WHEN g_status = 'succeeded' THEN 'Refund succeeded immediately.' ELSE
          'Refund initiated. Status is pending, confirmation will be sent via webhook.' END END
        AS message
    FROM refunds""",
    REFUND,
)
sql(
    "customer_refund_lines",
    """SELECT j.payment_id, j.user_id, j.reservation_id, j.event_detail_id, j.price AS amount,
      j.title, j.ticket_description, j.show_date
    FROM judged j JOIN refunds r USING (payment_id, user_id)
    WHERE j.eligible AND r.outcome NOT IN ('not_found', 'error', 'not_eligible')""",
    REFUND,
)
GIVEN_BACK = REFUND + """,
given_back AS (SELECT j.reservation_id, j.event_detail_id
  FROM judged j JOIN refunds r USING (payment_id, user_id)
  WHERE j.eligible AND r.outcome NOT IN ('not_found', 'error', 'not_eligible'))"""
sql(
    "customer_refund_reservations",
    "SELECT * FROM bk_tickets WHERE id NOT IN (SELECT reservation_id FROM given_back)",
    GIVEN_BACK,
)
sql(
    "customer_refund_inventory",
    """SELECT d.id, d.event_id, CAST(d.tickets_remaining + (SELECT count(*) FROM given_back g
      WHERE g.event_detail_id = d.id) AS INTEGER) AS tickets_remaining FROM bk_event_details d""",
    GIVEN_BACK,
)
# A refund that reached the gateway ends with the original amount, so only the status changes;
# "no_amount" refunds only zero-priced tickets, which leaves the amount as it was too.
sql(
    "customer_refund_payments",
    NEW_PAYMENT.format(
        edits="""SELECT payment_id AS id, user_id, amount, payment_intent_id,
        new_status AS status FROM refunds WHERE new_status IS NOT NULL"""
    ).replace(",\n      n.id IS NOT NULL AS updated", ""),
    REFUND,
)


def answered(rows: str, note: str, tiers: bool = False) -> str:
    """What the gateway calls do to ``rows``; with ``tiers``, a price's own answer comes first."""
    source = "bk_outcomes o ON o.payment_id = t.payment_id AND o.action = t.act"
    if tiers:
        source = """(SELECT payment_id, action, NULL AS price, status, code, message, failure_reason,
      error FROM bk_outcomes UNION ALL SELECT * FROM tier_answers) o
    ON o.payment_id = t.payment_id AND o.action = t.act AND (o.price = t.price OR (o.price IS NULL
      AND NOT EXISTS (SELECT 1 FROM tier_answers x WHERE x.payment_id = t.payment_id
        AND x.action = t.act AND x.price = t.price)))"""
    return f"""
tier_answers AS (SELECT DISTINCT r.payment_id, 'refund' AS action, d.price,
    CASE WHEN r.payment_id % 2 = 0 THEN 'failed' ELSE 'pending' END AS status,
    CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS message,
    CASE WHEN r.payment_id % 2 = 0 THEN 'expired_card' END AS failure_reason,
    CAST(NULL AS VARCHAR) AS error
  FROM bk_tickets r JOIN bk_event_details d ON d.id = r.event_detail_id
  WHERE r.payment_id % 3 = 0 AND d.id % 3 = 2),
acted AS (SELECT t.*, t.act AS action,
    CASE WHEN o.error = 'gateway' THEN coalesce(o.code, '') WHEN o.error = 'other' THEN ''
      WHEN t.act = 'refund' THEN o.status ELSE 'cancelled' END AS log_status,
    CASE WHEN o.error = 'gateway' THEN o.message WHEN o.error = 'other' THEN NULL
      WHEN t.act = 'refund' THEN CASE o.status WHEN 'failed' THEN o.failure_reason
        WHEN 'pending' THEN 'refund pending' ELSE 'refund succeeded' END ELSE '{note}' END
      AS log_description,
    CASE WHEN o.error = 'gateway' THEN NULL WHEN o.error = 'other' THEN ''
      WHEN t.act = 'refund' THEN CASE o.status WHEN 'failed' THEN '' WHEN 'pending'
        THEN 'refund pending' ELSE 'refunded' END ELSE 'cancelled' END AS new_status,
    CASE WHEN o.error = 'gateway' THEN 'gateway_error' WHEN o.error = 'other' THEN 'error'
      WHEN t.act = 'refund' THEN CASE o.status WHEN 'failed' THEN 'refund_failed' WHEN 'pending'
        THEN 'refund_pending' ELSE 'refunded' END ELSE 'cancelled' END AS outcome,
    CASE WHEN o.error = 'gateway' THEN CASE t.act WHEN 'refund' THEN 'stripe refund request'
      ELSE 'stripe cancel request' END END AS failed_action,
    CASE WHEN o.error = 'gateway' THEN coalesce(o.code, '') END AS failed_code,
    CASE WHEN o.error = 'gateway' THEN o.message END AS failed_message
  FROM (SELECT *, CASE WHEN status = 'succeeded' THEN 'refund' ELSE 'cancel' END AS act
    FROM {rows}) t
  LEFT JOIN {source})
"""


EVENT_PLAN = (
    OWNED
    + """,
live AS (SELECT *, CAST(CASE WHEN amount = 0 THEN 0 ELSE ticket_price END AS DECIMAL(20,2))
    AS refund_amount FROM event_totals WHERE status NOT IN ('refunded', 'cancelled')),"""
    + answered("live", "event deleted", True)
    + """,
plan AS (SELECT event_id, payment_id, payment_intent_id, payer_user_id, amount, status, title, price,
  refund_amount, action, log_status, log_description, new_status, outcome, failed_action,
  failed_code, failed_message, amount = 0 OR failed_action IS NULL AS notify FROM acted)
"""
)
sql("event_cancel_plan", "SELECT * FROM plan", EVENT_PLAN)
sql(
    "event_cancel_payments",
    NEW_PAYMENT.format(
        edits="""SELECT payment_id AS id, payer_user_id AS user_id, refund_amount AS amount,
        payment_intent_id, new_status AS status FROM plan WHERE new_status IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY payment_id
          ORDER BY refund_amount DESC, new_status DESC) = 1"""
    ).replace(",\n      n.id IS NOT NULL AS updated", ""),
    EVENT_PLAN,
)
sql(
    "event_cancel_reservations",
    """SELECT r.* FROM bk_reservations r JOIN bk_event_details d ON d.id = r.event_detail_id
    WHERE d.event_id % 9 = 0""",
)
sql(
    "event_cancel_logs",
    f"""SELECT sha256(concat_ws('-', 'log', event_id, payment_id, price, payment_intent_id)) AS id,
      log_status AS status, log_description AS description,
      coalesce(payment_intent_id, '') AS payment_intent_id,
      CAST(NULL AS VARCHAR) AS payment_method_id,
      CAST(refund_amount AS DECIMAL(10,2)) AS amount, {AS_OF} AS created_at, user_email, payment_id
    FROM plan JOIN owned_events USING (event_id) WHERE log_status IS NOT NULL""",
    EVENT_PLAN,
)
DETAIL_PLAN = (
    OWNED
    + """,
one_each AS (SELECT * FROM (SELECT * FROM detail_totals WHERE payment_intent_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY event_detail_id, payment_intent_id
      ORDER BY created_at DESC, payment_id DESC) = 1)
  WHERE status NOT IN ('refunded', 'cancelled')),
paid_rows AS (SELECT t.*, k.user_id AS owner_id, amount = 0 OR ticket_price = 0 AS free,
    CAST(CASE WHEN amount = 0 OR ticket_price = 0 THEN 0 ELSE ticket_price END AS DECIMAL(20,2))
      AS refund_amount
  FROM one_each t JOIN owned_details k USING (event_detail_id)),"""
    + answered("paid_rows", "event detail deleted")
    + """,
plan AS (SELECT event_detail_id, payment_intent_id, payment_id, payer_user_id, amount, status, title,
  ticket_description, owner_id, refund_amount, CASE WHEN free THEN 'notice' ELSE action END AS action,
  CASE WHEN NOT free THEN log_status END AS log_status,
  CASE WHEN NOT free THEN log_description END AS log_description,
  CASE WHEN NOT free THEN new_status END AS new_status,
  CASE WHEN free THEN 'free' ELSE outcome END AS outcome,
  CASE WHEN NOT free THEN failed_action END AS failed_action,
  CASE WHEN NOT free THEN failed_code END AS failed_code,
  CASE WHEN NOT free THEN failed_message END AS failed_message,
  free OR failed_action IS NULL AS notify,
  NOT free AND new_status IS NOT NULL AND owner_id = payer_user_id AS update_applies FROM acted)
"""
)
sql("detail_cancel_plan", "SELECT * FROM plan", DETAIL_PLAN)
sql(
    "detail_cancel_payments",
    NEW_PAYMENT.format(
        edits="""SELECT payment_id AS id, owner_id AS user_id, refund_amount AS amount,
        payment_intent_id, new_status AS status FROM plan WHERE update_applies
        QUALIFY row_number() OVER (PARTITION BY payment_id
          ORDER BY refund_amount DESC, new_status DESC) = 1"""
    ).replace(",\n      n.id IS NOT NULL AS updated", ""),
    DETAIL_PLAN,
)
sql(
    "detail_cancel_logs",
    f"""SELECT sha256(concat_ws('-', 'log', event_detail_id, payment_id, payment_intent_id)) AS id,
      log_status AS status, log_description AS description, payment_intent_id,
      CAST(NULL AS VARCHAR) AS payment_method_id,
      CAST(refund_amount AS DECIMAL(10,2)) AS amount, {AS_OF} AS created_at, user_email, payment_id
    FROM plan JOIN owned_details USING (event_detail_id) WHERE log_status IS NOT NULL""",
    DETAIL_PLAN,
)

# --- webhooks -----------------------------------------------------------------------------------

INTENTS = "('payment_intent.succeeded', 'payment_intent.payment_failed', 'payment_intent.requires_action')"
FOLD = f"""
hooks AS (SELECT *, CASE WHEN broken IS NOT NULL THEN broken
    WHEN type = 'customer.created' THEN 'unhandled_type'
    WHEN type IN {INTENTS} AND ref IS NULL THEN 'missing_payment_id'
    WHEN type IN {INTENTS} AND cents > 9999999999 THEN 'bad_amount'
    WHEN type IN {INTENTS} AND TRY_CAST(ref AS BIGINT) IS NULL THEN 'bad_payment_id'
    WHEN type IN {INTENTS} AND TRY_CAST(ref AS BIGINT) NOT IN (SELECT id FROM bk_payments)
      THEN 'unknown_payment'
    WHEN type NOT IN {INTENTS} AND intent_id IS NULL THEN 'missing_intent' END AS why
  FROM bk_webhooks),
intent_hooks AS (SELECT *, CAST(ref AS BIGINT) AS payment_id FROM hooks
  WHERE why IS NULL AND type IN {INTENTS}),
spans AS (SELECT payment_id, intent_id, seq AS from_seq,
    lead(seq) OVER (PARTITION BY payment_id ORDER BY seq) AS to_seq
  FROM (SELECT payment_id, intent_id, seq FROM intent_hooks
    UNION ALL SELECT id, payment_intent_id, -1 FROM bk_payments)),
refund_hooks AS (SELECT h.*, (SELECT arg_min(p.id, (p.created_at, p.id)) FROM spans s
      JOIN bk_payments p ON p.id = s.payment_id
      WHERE s.intent_id = h.intent_id AND s.from_seq < h.seq
        AND (s.to_seq IS NULL OR h.seq < s.to_seq)) AS payment_id
  FROM hooks h WHERE why IS NULL AND type NOT IN {INTENTS}),
resolved AS (SELECT * FROM intent_hooks UNION ALL
  SELECT * FROM refund_hooks WHERE payment_id IS NOT NULL),
ordered AS (SELECT r.*, p.status AS s0, p.amount AS a0, p.payment_intent_id AS i0, p.user_id,
    p.expires_at, p.created_at,
    count(*) FILTER (WHERE r.type <> 'charge.refunded') OVER w AS others_before,
    count(*) FILTER (WHERE r.type = 'charge.refunded') OVER w AS refunds_before
  FROM resolved r JOIN bk_payments p ON p.id = r.payment_id
  WINDOW w AS (PARTITION BY r.payment_id ORDER BY r.seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, type <> 'charge.refunded' OR (s0 = 'refund pending' AND others_before = 0
    AND refunds_before = 0) AS counts,
  CASE type WHEN 'payment_intent.succeeded' THEN 'succeeded'
    WHEN 'payment_intent.payment_failed' THEN 'payment_failed'
    WHEN 'payment_intent.requires_action' THEN 'requires_action'
    WHEN 'charge.refunded' THEN 'refunded' ELSE 'refund_failed' END AS set_status
  FROM ordered),
applied AS (SELECT * FROM judged WHERE counts)
"""
FOLDED = f"""SELECT p.id, CASE WHEN f.last_intent_seq IS NOT NULL THEN f.intent ELSE p.payment_intent_id
        END AS payment_intent_id,
      CAST(coalesce(f.cents / 100.0, p.amount) AS DECIMAL(10,2)) AS amount, p.currency, f.status,
      p.expires_at, p.created_at, {AS_OF} AS updated_at, p.user_id
    FROM bk_payments p JOIN (SELECT payment_id, arg_max(set_status, seq) AS status,
        arg_max(CASE WHEN type = 'charge.refunded' THEN 0 ELSE cents END, seq)
          FILTER (WHERE type <> 'refund.failed') AS cents,
        arg_max(intent_id, seq) FILTER (WHERE type IN {INTENTS}) AS intent,
        max(seq) FILTER (WHERE type IN {INTENTS}) AS last_intent_seq
      FROM applied GROUP BY 1) f ON f.payment_id = p.id"""
sql("webhook_fold_payments", FOLDED, FOLD)
sql("webhook_fold_sliced", FOLDED, FOLD)
sql(
    "webhook_logs",
    f"""SELECT sha256('log-' || seq) AS id,
      CASE type WHEN 'charge.refunded' THEN 'succeeded' WHEN 'refund.failed' THEN 'failed'
        ELSE set_status END AS status,
      CASE type WHEN 'payment_intent.succeeded' THEN 'Payment succeeded.'
        WHEN 'payment_intent.payment_failed' THEN error_message
        WHEN 'payment_intent.requires_action' THEN
          'Payment requires action. Please complete the action before '
          || strftime(expires_at, '%Y-%m-%d %H:%M:%S')
        WHEN 'charge.refunded' THEN 'Refund confirmed by Stripe webhook. Amount set to 0.00.'
        ELSE 'Refund failed: ' || failure_reason END AS description,
      intent_id AS payment_intent_id, payment_method_id,
      CAST(cents / 100.0 AS DECIMAL(10,2)) AS amount, {AS_OF} AS created_at,
      u.email AS user_email, payment_id
    FROM applied a JOIN bk_users u ON u.id = a.user_id WHERE cents <= 9999999999""",
    FOLD,
)
sql(
    "webhook_quarantine",
    """SELECT seq, CASE WHEN broken IS NULL THEN type END AS type, why AS reason FROM hooks
      WHERE why IS NOT NULL
    UNION ALL SELECT seq, type, 'unknown_intent' FROM refund_hooks WHERE payment_id IS NULL
    UNION ALL SELECT seq, type, 'not_refund_pending' FROM judged WHERE NOT counts
    UNION ALL SELECT seq, type, 'bad_log_amount' FROM applied WHERE cents > 9999999999""",
    FOLD,
)

# --- outbox --------------------------------------------------------------------------------------

MAILS = (
    FOLD
    + """,
mail_lines AS (SELECT payment_id, string_agg(title || ' - ' || ticket_description || ' - '
      || strftime(show_date, '%Y-%m-%d %H:%M:%S') || ' +0000 +0000' || chr(10), ''
      ORDER BY event_detail_id) AS lines
  FROM (SELECT DISTINCT r.payment_id, d.id AS event_detail_id, e.title, d.ticket_description,
      d.show_date
    FROM bk_reservations r JOIN bk_event_details d ON d.id = r.event_detail_id
    JOIN bk_events e ON e.id = d.event_id) GROUP BY 1),
people AS (SELECT id AS user_id, firstname || ' ' || lastname AS name, email FROM bk_users)
"""
)
TEAM = "'- The booking team'"
sql(
    "notify_confirmed",
    f"""SELECT seq AS mail_key, payment_id, name || ' <' || email || '>' AS recipient,
      'Your payment and ticket reservation is confirmed' AS subject,
      'Hi ' || name || ',' || chr(10) || chr(10) || 'You''ve successfully booked your events. Enjoy!'
      || chr(10) || lines || chr(10) || chr(10) || {TEAM} AS body
    FROM applied JOIN mail_lines USING (payment_id) JOIN people USING (user_id)
    WHERE type = 'payment_intent.succeeded'""",
    MAILS,
)
sql(
    "mail_lines",
    """SELECT DISTINCT r.payment_id, d.id AS event_detail_id, e.title || ' - ' || d.ticket_description
      || ' - ' || strftime(d.show_date, '%Y-%m-%d %H:%M:%S') || ' +0000 +0000' AS line
    FROM bk_reservations r JOIN bk_event_details d ON d.id = r.event_detail_id
    JOIN bk_events e ON e.id = d.event_id
    WHERE r.payment_id IN (SELECT payment_id FROM applied WHERE type = 'payment_intent.succeeded')""",
    FOLD,
)
sql(
    "notify_booked",
    f"""SELECT c.payment_id AS mail_key, c.payment_id,
      name || ' <' || c.user_email || '>' AS recipient,
      'Your payment and ticket reservation is confirmed' AS subject,
      'Hi ' || name || ',' || chr(10) || chr(10) || 'You''ve successfully booked your events. Enjoy!'
      || chr(10) || lines || chr(10) || chr(10) || {TEAM} AS body
    FROM charged c JOIN mail_lines USING (payment_id) JOIN people USING (user_id) WHERE notify""",
    CHARGED + "," + MAILS,
)
sql(
    "notify_payment_failed",
    f"""SELECT seq AS mail_key, payment_id, name || ' <' || email || '>' AS recipient,
      'Your payment failed' AS subject,
      'Hi ' || name || ',' || chr(10) || chr(10) || 'Your payment failed with the following issue: '
      || error_message || chr(10) || chr(10) || 'Reservation/s attached with the payment:' || chr(10)
      || lines || chr(10) || chr(10) || {TEAM} AS body
    FROM applied JOIN mail_lines USING (payment_id) JOIN people USING (user_id)
    WHERE type = 'payment_intent.payment_failed'""",
    MAILS,
)
sql(
    "webhook_outbox",
    f"""SELECT sha256('mail-' || seq) AS mail_key, payment_id,
      CASE WHEN payer THEN name || ' <' || email || '>' ELSE 'Booking team <team@example.com>' END AS recipient,
      CASE type WHEN 'payment_intent.succeeded' THEN 'Your payment and ticket reservation is confirmed'
        WHEN 'payment_intent.payment_failed' THEN 'Your payment failed' ELSE 'A refund request has failed' END AS subject,
      CASE type WHEN 'payment_intent.succeeded' THEN 'Hi ' || name || ',' || chr(10) || chr(10)
          || 'You''ve successfully booked your events. Enjoy!' || chr(10) || lines || chr(10) || chr(10) || {TEAM}
        WHEN 'payment_intent.payment_failed' THEN 'Hi ' || name || ',' || chr(10) || chr(10)
          || 'Your payment failed with the following issue: ' || error_message || chr(10) || chr(10)
          || 'Reservation/s attached with the payment:' || chr(10) || lines || chr(10) || chr(10) || {TEAM}
        ELSE 'A refund request has failed. Please check logs.' END AS body
    FROM (SELECT *, type <> 'refund.failed' AS payer FROM applied
      WHERE type IN ('payment_intent.succeeded', 'payment_intent.payment_failed', 'refund.failed'))
    LEFT JOIN mail_lines USING (payment_id) LEFT JOIN people USING (user_id)
    WHERE NOT payer OR lines IS NOT NULL AND name IS NOT NULL""",
    MAILS,
)
sql(
    "notify_cancelled",
    """SELECT DISTINCT event_id, payment_id,
      u.firstname || ' ' || u.lastname || ' <' || u.email || '>' AS recipient,
      'Your payment for ' || title || ' was refunded/cancelled' AS subject,
      'The event: ' || title || ', that you booked was cancelled and your payment was refunded. If you didn''t pay yet, the pending payment is now cancelled.'
        AS body, CAST(NULL AS VARCHAR) AS failure
    FROM plan JOIN bk_users u ON u.id = payer_user_id WHERE notify""",
    EVENT_PLAN,
)
sql(
    "notify_detail_cancelled",
    f"""SELECT event_detail_id, payment_id, name || ' <' || email || '>' AS recipient,
      'Your payment for ' || title || ' was refunded/cancelled' AS subject,
      'Hi ' || name || ',' || chr(10) || chr(10) || 'The event reservation you''ve booked: ' || title
      || ' - ' || ticket_description || ', was cancelled and your payment was refunded. ' || chr(10)
      || 'If you didn''t pay yet, the pending payment is now cancelled.' || chr(10)
      || 'Sorry for the inconvencience.' || chr(10) || chr(10) || {TEAM} AS body,
      CAST(NULL AS VARCHAR) AS failure
    FROM plan JOIN (SELECT id AS payer_user_id, firstname || ' ' || lastname AS name, email
      FROM bk_users) USING (payer_user_id) WHERE notify""",
    DETAIL_PLAN,
)
sql(
    "notify_refund_error",
    """SELECT mail_key, 'Booking team <team@example.com>' AS recipient,
      'A refund request has failed' AS subject,
      'A refund request has failed. Please check logs.' AS body
    FROM (SELECT 'webhook-' || seq AS mail_key FROM applied WHERE type = 'refund.failed'
      UNION ALL SELECT 'detail-' || event_detail_id || '-' || payment_id FROM plan
      WHERE action = 'refund' AND outcome IN ('gateway_error', 'error'))""",
    FOLD + "," + DETAIL_PLAN,
)
sql(
    "notify_event_updated",
    f"""SELECT a.event_id, a.user_id, full_name || ' <' || email || '>' AS recipient,
      'Your booked event was updated' AS subject,
      'Hi ' || full_name || ',' || chr(10) || chr(10) || 'You are receiving this email because your booked event has been updated. Please refer to details below.'
      || chr(10) || chr(10) || 'Title: ' || e.title || chr(10) || 'Description: ' || e.description
      || chr(10) || CASE WHEN trim(coalesce(e.organizer, '')) <> '' THEN 'Organizer: ' || e.organizer
        || chr(13) || chr(10) ELSE '' END || chr(10) || {TEAM} AS body
    FROM ({ATTENDEES.format(events="(SELECT * FROM edited WHERE updated)")}) a
    JOIN edited e ON e.id = a.event_id""",
    EDITS,
)
