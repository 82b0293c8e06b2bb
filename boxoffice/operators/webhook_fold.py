"""Payment status out of gateway webhooks, applied in arrival order.

The fold needs no per-payment loop. Every event but ``charge.refunded`` sets the status whatever
it was, and a webhook never sets the one status that ``charge.refunded`` waits for. So at most
one ``charge.refunded`` per payment counts: the first, if nothing came before it and the payment
was waiting. All the rest is minimum and maximum, which Spark combines before it shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from boxoffice.functions import columns as c, fixed as fx
from boxoffice.functions.scale import SPLIT_ROWS, materialize, running, slice_hot_keys
from boxoffice.sources.webhooks import INTENT_TYPES

@dataclass(frozen=True)
class WebhookResult:
    """``payments``: the rows that changed, in their new version. ``logs``: audit entries.
    ``quarantine``: every event that was not applied, with the reason. ``applied``: the rest."""

    payments: DataFrame
    logs: DataFrame
    quarantine: DataFrame
    applied: DataFrame


@dataclass(frozen=True)
class Arrivals:
    """How many events a batch has, and the arrival numbers [begin, end) they lie in."""

    rows: int
    begin: int
    end: int


def resolve_events(
    typed: DataFrame,
    payments: DataFrame,
    users: DataFrame,
    arrivals: Arrivals,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Find each event's payment. Intent events name it; refund events carry an intent id, which
    is looked up as it stood when the event arrived."""
    kind = payments.schema["id"].dataType.simpleString()
    known = payments.select(
        F.col("id").alias("payment_id"),
        F.col("user_id").alias("payer"),
        "created_at",
        F.lit(True).alias("has_payment"),
    )
    people = users.select(F.col("id").alias("payer"), F.lit(True).alias("has_user"))
    is_intent = F.col("type").isin(*INTENT_TYPES)
    intents = typed.filter(F.col("reason").isNull() & is_intent)
    named = (
        intents.withColumn("payment_id", c.parse_id(F.col("payment_ref"), kind))
        .join(known, "payment_id", "left")
        .join(people, "payer", "left")
        .withColumn(
            "reason",
            F.when(F.col("payment_id").isNull(), "bad_payment_id")
            .when(F.col("has_payment").isNull(), "unknown_payment")
            .when(F.col("has_user").isNull(), "unknown_user"),
        )
    )
    held = named.filter(F.col("reason").isNull()).select(
        "payment_id", "intent_id", "created_at", "seq"
    )
    spans = _spans(held, payments, arrivals, intents.select("payment_ref"), split_rows)
    refunds = typed.filter(F.col("reason").isNull() & ~is_intent)
    found = _holders_as_of(refunds, spans, arrivals)
    columns = [*typed.columns, "payment_id"]
    return (
        named.select(*columns)
        .unionByName(
            found.withColumn(
                "reason", F.when(F.col("payment_id").isNull(), "unknown_intent")
            ).select(*columns)
        )
        .unionByName(
            typed.filter(F.col("reason").isNotNull()).withColumn(
                "payment_id", F.lit(None).cast(kind)
            )
        )
    )


def touch_keys(typed: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """What the events can touch: the payment ids (``id``, of type ``kind``) that they name, and the intent
    ids (``payment_intent_id``) that refund events carry."""
    live = typed.filter(F.col("reason").isNull())
    named = live.select(c.parse_id(F.col("payment_ref"), kind).alias("id")).filter("id is not null")
    carried = live.filter(~F.col("type").isin(*INTENT_TYPES) & F.col("intent_id").isNotNull()).select(
        F.col("intent_id").alias("payment_intent_id")
    )
    return named, carried.distinct()


def touchable(typed: DataFrame, payments: DataFrame) -> DataFrame:
    """The ids of the payments that the events name, or that hold an intent id they carry. Only two
    columns of the payments are read."""
    named, carried = touch_keys(typed, payments.schema["id"].dataType.simpleString())
    holding = payments.select("id", "payment_intent_id").join(
        carried, "payment_intent_id", "left_semi"
    )
    return named.unionByName(holding.select("id")).distinct()


def _spans(
    held: DataFrame, payments: DataFrame, arrivals: Arrivals, probe: DataFrame, split_rows: int
) -> DataFrame:
    """Which payment held which intent id when: rows (intent_id, p, lo, hi), where ``p`` sorts by
    age and [lo, hi) counts arrivals from the first of the batch."""
    begin, end = arrivals.begin, arrivals.end
    stored = payments.select(
        F.col("id").alias("payment_id"),
        F.col("payment_intent_id").alias("intent_id"),
        "created_at",
        F.lit(begin - 1).cast("long").alias("seq"),
    )
    # A payment without an event holds its id throughout.
    touched = held.select("payment_id").distinct()
    still = stored.join(touched, "payment_id", "left_anti").filter(
        F.coalesce("intent_id", F.lit("")) != ""
    )
    # An absent id is the empty text here, so that it ends the span of the id before it.
    moves = (
        stored.join(touched, "payment_id", "left_semi")
        .unionByName(held)
        .withColumn("intent_id", F.coalesce("intent_id", F.lit("")))
    )
    moves = slice_hot_keys(
        moves, ["payment_id"], ["seq"], split_rows, probe, arrivals.rows
    )
    changes = running(
        moves, ["payment_id"], ["seq"], lasts={"held": F.col("intent_id")}
    ).filter(F.col("held").isNull() | (F.col("held") != F.col("intent_id")))
    holder = F.struct("created_at", "payment_id").alias("p")
    moved = (
        running(changes.drop("held"), ["payment_id"], ["seq"], nexts={"until": F.col("seq")})
        .filter(F.col("intent_id") != "")
        .select(
            "intent_id",
            holder,
            (F.col("seq") + 1 - begin).alias("lo"),
            (F.coalesce("until", F.lit(end)) - begin).alias("hi"),
        )
    )
    whole = [F.lit(0).cast("long").alias("lo"), F.lit(end - begin).cast("long").alias("hi")]
    return moved.unionByName(still.select("intent_id", holder, *whole))


def _holders_as_of(refunds: DataFrame, spans: DataFrame, arrivals: Arrivals) -> DataFrame:
    """Add ``payment_id``: the oldest payment that held the intent id when the event arrived.

    All payments that hold an id throughout the batch are stood for by their oldest. An id with
    one shorter span more needs a plain join. An id with several is met through blocks: a span is
    cut into blocks of 2^k arrivals, each block keeps its oldest payment, and an event looks up
    the block around it at every size. So rows never multiply with the payments of an id.
    """
    begin, length = arrivals.begin, arrivals.end - arrivals.begin
    whole = (F.col("lo") == 0) & (F.col("hi") == length)
    holders = spans.groupBy("intent_id").agg(
        F.min(F.when(whole, F.col("p"))).alias("throughout"),
        F.count_if(~whole).alias("others"),
        F.min(F.when(~whole, F.col("p"))).alias("other"),
        F.min(F.when(~whole, F.col("lo"))).alias("lo"),
        F.max(F.when(~whole, F.col("hi"))).alias("hi"),
    )
    arrival = F.col("seq") - begin
    inside = (arrival >= F.col("lo")) & (arrival < F.col("hi"))
    plain = refunds.join(holders, "intent_id", "left").withColumn(
        "other", F.when((F.col("others") == 1) & inside, F.col("other"))
    )

    crowded = holders.filter(F.col("others") > 1).select("intent_id")
    sizes = F.sequence(F.lit(0), F.lit(length.bit_length()))
    odd_ends = F.array(
        F.when(F.col("first") % 2 == 1, F.col("first")),
        F.when(F.col("last") % 2 == 1, F.col("last") - 1),
    )
    blocks = (
        spans.filter(~whole)
        .join(crowded, "intent_id", "left_semi")
        .withColumn("k", F.explode(sizes))
        .withColumn("first", F.expr("shiftright(lo - 1, k) + 1"))
        .withColumn("last", F.expr("shiftright(hi, k)"))
        .filter(F.col("first") < F.col("last"))
        .withColumn("block", F.explode(F.array_compact(odd_ends)))
        .groupBy("intent_id", "k", "block")
        .agg(F.min("p").alias("p"))
    )
    used = blocks.groupBy("intent_id").agg(F.collect_set("k").alias("ks"))
    met = (
        refunds.select("seq", "intent_id")
        .join(used, "intent_id")
        .withColumn("k", F.explode("ks"))
        .withColumn("block", F.expr(f"shiftright(seq - {begin}L, k)"))
        .join(blocks, ["intent_id", "k", "block"])
        .groupBy("seq")
        .agg(F.min("p").alias("met"))
    )
    return plain.join(met, "seq", "left").withColumn(
        "payment_id", F.least("throughout", "other", "met")["payment_id"]
    )


def fold_webhooks(
    typed: DataFrame,
    payments: DataFrame,
    users: DataFrame,
    as_of,
    dedupe: bool = False,
    split_rows: int = SPLIT_ROWS,
) -> WebhookResult:
    """Apply parsed webhooks (``seq`` is the arrival number, unique) to the payments table.

    A repeated event is applied and logged again, as it arrives; ``dedupe`` drops rows that
    repeat an earlier one in everything but ``seq``. Only payments that the events can touch are
    looked at any further. A refund event whose amount is beyond the money type is applied, but has
    no audit row; quarantine says so (``bad_log_amount``).
    """
    if dedupe:
        same = [n for n in typed.columns if n != "seq"]
        first = typed.groupBy(*same).agg(F.min("seq").alias("seq"))
        typed = first.select(*typed.columns)
    # Both are read by many branches: bodies are parsed once and payments looked up once.
    seen = Observation()
    typed = materialize(
        typed,
        "webhooks",
        seen,
        F.count("*").alias("rows"),
        F.min("seq").alias("first"),
        F.max("seq").alias("last"),
    )
    payments = materialize(
        payments.join(touchable(typed, payments), "id", "left_semi").select(*payments.columns),
        "in-play",
    )
    arrivals = Arrivals(seen.get["rows"], seen.get["first"] or 0, (seen.get["last"] or 0) + 1)
    events = materialize(
        resolve_events(typed, payments, users, arrivals, split_rows), "resolved"
    )
    live = events.filter(F.col("reason").isNull())

    is_intent = F.col("type").isin(*INTENT_TYPES)
    is_refund = F.col("type") == fx.TYPE_REFUNDED
    status = (
        F.when(F.col("type") == fx.TYPE_SUCCEEDED, fx.SUCCEEDED)
        .when(F.col("type") == fx.TYPE_FAILED, fx.PAYMENT_FAILED)
        .when(F.col("type") == fx.TYPE_ACTION, fx.REQUIRES_ACTION)
        .when(F.col("type") == fx.TYPE_REFUND_FAILED, fx.REFUND_FAILED)
    )
    seq = F.col("seq")
    per_payment = live.groupBy("payment_id").agg(
        F.min(F.when(is_refund, seq)).alias("refund_seq"),
        F.min(F.when(~is_refund, seq)).alias("other_seq"),
        F.max_by(status, F.when(~is_refund, seq)).alias("last_status"),
        F.max_by("cents", F.when(is_intent, seq)).alias("last_cents"),
        F.max_by("intent_id", F.when(is_intent, seq)).alias("last_intent"),
        F.max(F.when(is_intent, seq)).alias("intent_seq"),
    )
    confirmed = (
        (F.col("status") == fx.REFUND_PENDING)
        & F.col("refund_seq").isNotNull()
        & (F.col("other_seq").isNull() | (F.col("refund_seq") < F.col("other_seq")))
    )
    state = (
        per_payment.join(payments.withColumnRenamed("id", "payment_id"), "payment_id")
        .withColumn("confirmed", F.coalesce(confirmed, F.lit(False)))
    )
    changed = state.filter(F.col("confirmed") | F.col("other_seq").isNotNull())
    had_intent = F.col("intent_seq").isNotNull()
    new_values = {
        "id": F.col("payment_id"),
        "payment_intent_id": F.when(
            had_intent, c.null_if_blank_text("last_intent")
        ).otherwise(F.col("payment_intent_id")),
        "amount": F.when(had_intent, c.from_cents("last_cents"))
        .when(F.col("confirmed"), F.lit(0).cast(fx.MONEY))
        .otherwise(F.col("amount")),
        "status": F.coalesce("last_status", F.lit(fx.REFUNDED)),
        "updated_at": c.clock(as_of),
    }
    new_payments = changed.select(
        *[new_values.get(n, F.col(n)).alias(n) for n in payments.columns]
    )

    counted = state.filter("confirmed").select(
        "payment_id", F.col("refund_seq").alias("seq"), F.lit(True).alias("counts")
    )
    refunds = live.filter(is_refund).join(counted, ["payment_id", "seq"], "left")
    ignored = refunds.filter(F.col("counts").isNull()).withColumn(
        "reason", F.lit("not_refund_pending")
    )
    applied = live.filter(~is_refund).unionByName(
        refunds.filter(F.col("counts").isNotNull()).drop("counts")
    )
    quarantine = (
        events.filter(F.col("reason").isNotNull())
        .unionByName(ignored.drop("counts"))
        .unionByName(
            applied.filter(c.from_cents("cents").isNull()).withColumn(
                "reason", F.lit("bad_log_amount")
            )
        )
        .select("seq", "type", "reason")
    )
    return WebhookResult(
        new_payments, _log_rows(applied, payments, users, as_of), quarantine, applied
    )


def _log_rows(applied: DataFrame, payments: DataFrame, users: DataFrame, as_of) -> DataFrame:
    payers = payments.select(
        F.col("id").alias("payment_id"), "user_id", "expires_at"
    ).join(
        users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email")),
        "user_id",
        "left",
    )
    kind = F.col("type")
    status: Column = (
        F.when(kind == fx.TYPE_FAILED, fx.PAYMENT_FAILED)
        .when(kind == fx.TYPE_ACTION, fx.REQUIRES_ACTION)
        .when(kind == fx.TYPE_REFUND_FAILED, fx.LOG_FAILED)
        .otherwise(fx.SUCCEEDED)
    )
    description = (
        F.when(kind == fx.TYPE_SUCCEEDED, fx.LOG_PAID)
        .when(kind == fx.TYPE_FAILED, c.null_if_blank_text("error_message"))
        .when(kind == fx.TYPE_ACTION, c.text(fx.LOG_ACTION, c.second_text("expires_at")))
        .when(kind == fx.TYPE_REFUNDED, fx.LOG_REFUND_CONFIRMED)
        .otherwise(c.text(fx.MSG_REFUND_FAILED, F.col("failure_reason")))
    )
    return applied.filter(c.from_cents("cents").isNotNull()).join(payers, "payment_id").select(
        c.derived_id(F.lit("log"), "seq").alias("id"),
        status.alias("status"),
        description.alias("description"),
        F.coalesce("intent_id", F.lit("")).alias("payment_intent_id"),
        "payment_method_id",
        c.from_cents("cents").alias("amount"),
        c.clock(as_of).alias("created_at"),
        F.coalesce("user_email", F.lit(fx.UNKNOWN_EMAIL)).alias("user_email"),
        "payment_id",
    )


def apply_payment_changes(payments: DataFrame, changes: DataFrame) -> DataFrame:
    """The whole payments table with the changed rows in place of the old ones."""
    return payments.join(changes.select("id"), "id", "left_anti").select(
        *payments.columns
    ).unionByName(changes)
