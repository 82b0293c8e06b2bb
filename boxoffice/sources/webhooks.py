"""Raw gateway webhooks to typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxoffice.functions import columns as c, fixed as fx
from boxoffice.functions.scale import arrival_numbers
from boxoffice.sources import schemas

INTENT_TYPES = (fx.TYPE_SUCCEEDED, fx.TYPE_FAILED, fx.TYPE_ACTION)
REFUND_TYPES = (fx.TYPE_REFUNDED, fx.TYPE_REFUND_FAILED)


def read_webhook_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stream JSON-lines files of ``seq, channel, value``."""
    return spark.readStream.schema(schemas.WEBHOOK_RAW).options(**options).json(path)


#: Arrival order of messages of several topics and partitions.
MESSAGE_ORDER = ["timestamp", "topic", "partition", "offset"]
#: Arrival numbers of a batch lie between its number and the next one times this.
BATCH_SPAN = 1 << 40


def read_webhook_topics(spark: SparkSession, servers: str, topics: str, **options) -> DataFrame:
    """Stream topics (with commas) of any number of partitions. Needs the Kafka package."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .options(**options)
        .load()
        .select(*MESSAGE_ORDER, F.col("value").cast("string").alias("value"))
    )


def number_messages(batch: DataFrame, batch_id: int) -> DataFrame:
    """One batch of messages as ``seq, channel, value``: numbered in arrival order, and unique over
    all batches. A batch that is run again gets the same numbers."""
    numbered = arrival_numbers(batch, MESSAGE_ORDER, "seq", batch_id * BATCH_SPAN)
    return numbered.select("seq", F.col("topic").alias("channel"), "value")


def without_repeats(raw: DataFrame, within: str) -> DataFrame:
    """A stream of raw webhooks without those that repeat the gateway's event id (``id``) of one that
    arrived up to ``within`` ("7 days") before. Spark keeps the ids of that time as state, over batches and
    restarts. Arrival is the batch's own time, so nothing is ever too late; a body that names no event,
    cannot be parsed or is too long is kept, and goes where the batch sends it."""
    fits = F.octet_length("value") <= fx.WEBHOOK_BODY_CAP_BYTES
    named = F.nullif(F.from_json(F.when(fits, F.col("value")), "id STRING")["id"], F.lit(""))
    place = [n for n in ("seq", "topic", "partition", "offset") if n in raw.columns]
    alone = F.concat_ws("-", F.lit("message"), *place)
    key = F.when(named.isNotNull(), F.concat(F.lit("event-"), named)).otherwise(alone)
    timed = raw.withColumns({"_event": key, "_arrived": F.current_timestamp()}).withWatermark("_arrived", within)
    return timed.dropDuplicatesWithinWatermark(["_event"]).drop("_event", "_arrived")


def parse_webhooks(raw: DataFrame) -> DataFrame:
    """``raw(seq, value)`` to one typed row per webhook. ``reason`` is set on a row that cannot
    be applied whatever the tables hold; it goes to quarantine."""
    fits = F.octet_length("value") <= fx.WEBHOOK_BODY_CAP_BYTES
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    body = F.from_json("value", schemas.WEBHOOK + ", _corrupt_record STRING", options)
    rows = raw.select("seq", fits.alias("fits"), F.when(fits, body).alias("b")).select(
        "seq", "fits", "b._corrupt_record", F.col("b.id").alias("event_id"), "b.type", F.col("b.data.object").alias("o")
    )
    is_intent = F.col("type").isin(*INTENT_TYPES)
    is_refund = F.col("type").isin(*REFUND_TYPES)
    typed = rows.select(
        "seq",
        "fits",
        "_corrupt_record",
        "event_id",
        "type",
        F.when(is_intent, F.col("o.id")).otherwise(F.col("o.payment_intent")).alias("intent_id"),
        F.coalesce(
            F.when(F.col("type") == fx.TYPE_REFUNDED, F.col("o.amount_refunded")).otherwise(
                F.col("o.amount")
            ),
            F.lit(0),
        ).alias("cents"),
        F.when(is_intent, F.nullif("o.payment_method", F.lit(""))).alias("payment_method_id"),
        F.coalesce(F.nullif("o.failure_reason", F.lit("")), F.lit(fx.LOG_UNKNOWN_REASON)).alias(
            "failure_reason"
        ),
        F.when(F.col("o.last_payment_error").isNull(), F.lit(fx.LOG_PAYMENT_FAILED))
        .otherwise(F.coalesce("o.last_payment_error.message", F.lit("")))
        .alias("error_message"),
        F.col("o.metadata").getItem("payment_id").alias("payment_ref"),
    )
    no_ref = F.coalesce(F.col("payment_ref"), F.lit("")) == ""
    no_intent = F.coalesce(F.col("intent_id"), F.lit("")) == ""
    reason = (
        F.when(~F.coalesce("fits", F.lit(False)), "oversize")
        .when(F.col("_corrupt_record").isNotNull() | F.col("type").isNull(), "bad_json")
        .when(~(is_intent | is_refund), "unhandled_type")
        .when(is_intent & no_ref, "missing_payment_id")
        .when(is_refund & no_intent, "missing_intent")
        .when(is_intent & c.from_cents("cents").isNull(), "bad_amount")
    )
    return typed.withColumn("reason", reason).drop("fits", "_corrupt_record")
