"""Texts, limits and patterns that results depend on.

Nothing here is computed. Every string is written as it must appear in a result.
"""

# --- limits ---------------------------------------------------------------
REFUND_WINDOW_HOURS = 48
PAYMENT_HOLD_MINUTES = 15
WEBHOOK_BODY_CAP_BYTES = 65536
PASSWORD_MIN_BYTES = 12
PASSWORD_MAX_BYTES = 20
MONEY = "decimal(10,2)"
MONEY_SUM = "decimal(20,2)"

# --- defaults -------------------------------------------------------------
DEFAULT_CURRENCY = "usd"
UNKNOWN_EMAIL = "unknown@example.com"

# --- payment statuses -----------------------------------------------------
PENDING = "pending"
SUCCEEDED = "succeeded"
REQUIRES_ACTION = "requires_action"
REQUIRES_PAYMENT_METHOD = "requires_payment_method"
PROCESSING = "processing"
CANCELED = "canceled"
CANCELLED = "cancelled"
PAYMENT_FAILED = "payment_failed"
REFUNDED = "refunded"
REFUND_PENDING = "refund pending"
REFUND_FAILED = "refund_failed"

# --- patterns -------------------------------------------------------------
# The rule's own form repeats a group inside a repeated group; Java's regular expressions go back
# over such a text without end, so the same set of addresses is written here without one.
# [ and ] are members of the local-part class; \z refuses a trailing newline.
EMAIL_PATTERN = (
    r"^[A-Za-z0-9][._\-\]\[A-Za-z0-9]*@[A-Za-z0-9]+([\-\.][A-Za-z0-9]+)*\.[A-Za-z]{2,15}\z"
)
SHOW_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{1,2}:[0-9]{2}\z"
UUID_PATTERN = (
    r"^(urn:uuid:[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|\{[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}"
    r"|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9a-fA-F]{32})\z"
)

# --- formats --------------------------------------------------------------
SHOW_DATE_FORMAT = "2006-01-02 15:04"  # quoted back to the user in a reject message
MAIL_ZONE_SUFFIX = " +0000 +0000"      # how a zone-less show date is printed in a mail

# --- registration ---------------------------------------------------------
MSG_EMAIL_INVALID = "invalid email or password"
MSG_EMAIL_TAKEN = "email address is already registered"
MSG_PASSWORD_WEAK = (
    "invalid password, password must contain at least 1 upper case letter, "
    "1 lower case letter, 1 digit and must be 12 to 20 characters long"
)

# --- intake ---------------------------------------------------------------
MSG_BAD_JSON = "error parsing JSON, please check all required fields are present"
MSG_BAD_SHOW_DATE = "error parsing show date '%s': expected format %s"
MSG_INTAKE_ERRORS = "encountered errors:\n"

# --- booking --------------------------------------------------------------
MSG_NO_TICKETS = "no tickets being reserved"
MSG_DETAIL_NOT_FOUND = "event detail with ID %s not found"
MSG_INSUFFICIENT = (
    "insufficient tickets remaining for one or more requested events: "
    "only %s tickets remaining for %s"
)
MSG_SHOW_PAST = "error booking ticket, show date is already past: %s, show date: %s"
MSG_PAYMENT_ERROR = "internal database error creating payment"
MSG_SOLD_OUT = "error reserving ticket, transaction rolled back: sql: no rows in result set"

# --- charge outcome -------------------------------------------------------
MSG_PAID = "payment successful"
MSG_FREE = "free reservation successful"
MSG_SEE_NEXT_ACTION = "please refer to next action and status"
MSG_COMPLETE_IN_TIME = "complete payment within next 15 minutes"
MSG_EXPIRED = "payment expired, please rebook your tickets"
MSG_PROCESSING = "payment processing, we'll send you an email once payment succeeded"
MSG_NEW_METHOD = "please submit new payment method"
MSG_RETRY_OK = "payment updated"
MSG_RETRY_UNKNOWN = "an unknown error occurred with payment update"
MSG_NO_INTENT = "payment record has no linked payment intent"
MSG_PAYMENT_NOT_FOUND = "payment not found"

# --- refunds and cancellations ---------------------------------------------
MSG_REFUND_ERRORS = "one or more errors occurred during reservation filtering:\n"
MSG_INTENT_MISSING = "payment intent ID is missing"
MSG_INCOMPLETE = "incomplete reservation details found"
MSG_NOT_ELIGIBLE = "no reservations were eligible for refund"
MSG_NO_AMOUNT = "no refund amount calculated after processing reservations"
MSG_REFUND_INITIATED = (
    "Refund initiated. Status is pending, confirmation will be sent via webhook."
)
MSG_REFUND_INIT_FAILED = "Refund initiation failed: %s"
MSG_REFUND_FAILED = "Refund failed: %s"
MSG_REFUND_NOW = "Refund succeeded immediately."
ACTION_REFUND = "stripe refund request"
ACTION_CANCEL = "stripe cancel request"
LOG_REFUND_PENDING = "refund pending"
LOG_REFUND_SUCCEEDED = "refund succeeded"
LOG_EVENT_DELETED = "event deleted"
LOG_DETAIL_DELETED = "event detail deleted"

# --- webhooks --------------------------------------------------------------
TYPE_SUCCEEDED = "payment_intent.succeeded"
TYPE_FAILED = "payment_intent.payment_failed"
TYPE_ACTION = "payment_intent.requires_action"
TYPE_REFUNDED = "charge.refunded"
TYPE_REFUND_FAILED = "refund.failed"
LOG_PAID = "Payment succeeded."
LOG_PAYMENT_FAILED = "Payment failed."
LOG_ACTION = "Payment requires action. Please complete the action before %s"
LOG_REFUND_CONFIRMED = "Refund confirmed by Stripe webhook. Amount set to 0.00."
LOG_UNKNOWN_REASON = "Unknown reason"
LOG_FAILED = "failed"

# --- mail texts; {team} is the caller's own signature line -------------------
MAIL_LINE = "%s - %s - %s"
SUBJECT_CONFIRMED = "Your payment and ticket reservation is confirmed"
BODY_CONFIRMED = (
    "Hi {name},\n\nYou've successfully booked your events. Enjoy!\n{lines}\n\n{team}"
)
SUBJECT_FAILED = "Your payment failed"
BODY_FAILED = (
    "Hi {name},\n\nYour payment failed with the following issue: {error}\n\n"
    "Reservation/s attached with the payment:\n{lines}\n\n{team}"
)
SUBJECT_CANCELLED = "Your payment for {title} was refunded/cancelled"
BODY_EVENT_CANCELLED = (
    "The event: {title}, that you booked was cancelled and your payment was refunded. "
    "If you didn't pay yet, the pending payment is now cancelled."
)
BODY_DETAIL_CANCELLED = (
    "Hi {name},\n\nThe event reservation you've booked: {title} - {ticket}, was cancelled "
    "and your payment was refunded. \nIf you didn't pay yet, the pending payment is now "
    "cancelled.\nSorry for the inconvencience.\n\n{team}"
)
SUBJECT_REFUND_ERROR = "A refund request has failed"
BODY_REFUND_ERROR = "A refund request has failed. Please check logs."
SUBJECT_UPDATED = "Your booked event was updated"
BODY_UPDATED = (
    "Hi {name},\n\nYou are receiving this email because your booked event has been updated. "
    "Please refer to details below.\n\nTitle: {title}\nDescription: {description}\n"
    "{organizer}\n{team}"
)
ORGANIZER_LINE = "Organizer: {organizer}\r\n"
