"""Webhooks as a stream: the batch fold, run on every micro-batch.

The payments table is the only state of the fold. A micro-batch writes just the payments it changed, under
a path of its own batch number, and the audit rows, rejects and notices next to them. A batch that is run
again after a failure overwrites its own paths and reads only older ones, so it ends the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from boxoffice.functions.scale import SPLIT_ROWS, materialize, scratch
from boxoffice.operators import outbox
from boxoffice.operators.webhook_fold import fold_webhooks, touch_keys
from boxoffice.sources.webhooks import number_messages, parse_webhooks, without_repeats
from boxoffice.streaming.payment_buckets import (
    BucketedPayments,
    columns_of,
    held_intents,
    touched,
    with_buckets,
    write_buckets,
)

#: Buckets of the changed payments of a batch.
BUCKETS = 64


@dataclass(frozen=True)
class WebhookStore:
    """Where the stream keeps its results: one folder per output, one ``batch=N`` below it.

    ``first_batch`` is the first batch that the base table does not hold yet. Writing
    ``current_payments`` out as a new base now and then, and raising it, keeps a batch from
    reading ever more old changes.
    """

    root: str
    first_batch: int = 0
    buckets: int = BUCKETS

    def path(self, name: str, batch_id: int | None = None) -> str:
        base = f"{self.root.rstrip('/')}/{name}"
        return base if batch_id is None else f"{base}/batch={batch_id}"

    def read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        return spark.read.schema(f"{schema}, batch BIGINT").parquet(self.path(name))

    def changes(
        self, spark: SparkSession, name: str, schema: str, before: int | None, buckets: list[int] | None
    ) -> DataFrame:
        """What the batches that the base does not hold have written, of some buckets or all. Both are
        folders, so that no other file is read."""
        table = spark.read.schema(f"{schema}, batch BIGINT, bucket INT").parquet(self.path(name))
        table = table.filter(F.col("batch") >= self.first_batch)
        table = table if before is None else table.filter(F.col("batch") < before)
        return table if buckets is None else table.filter(F.col("bucket").isin(buckets))


def _whole(spark: SparkSession, base: DataFrame | BucketedPayments) -> DataFrame:
    return base.all(spark) if isinstance(base, BucketedPayments) else base


def current_payments(
    base: DataFrame | BucketedPayments,
    store: WebhookStore,
    before_batch: int | None = None,
    spark: SparkSession | None = None,
) -> DataFrame:
    """The payments table as the stream has left it: each payment's latest changed row, else its
    row in the base table. ``batch`` is a partition column, so later folders are not read. A base in
    buckets needs ``spark``."""
    spark = spark or base.sparkSession
    base = _whole(spark, base)
    if before_batch is not None and before_batch <= store.first_batch:
        return base
    changes = store.changes(spark, "payments", columns_of(base), before_batch, None)
    row = F.struct(*base.columns)
    latest = changes.groupBy("id").agg(F.max_by(row, "batch").alias("new")).select("id", "new")
    return base.join(latest, "id", "left").select(
        *[
            F.when(F.col("new").isNotNull(), F.col(f"new.{n}")).otherwise(F.col(n)).alias(n)
            if n != "id"
            else F.col("id")
            for n in base.columns
        ]
    )


def payments_for(
    typed: DataFrame, base: DataFrame | BucketedPayments, store: WebhookStore, before_batch: int
) -> DataFrame:
    """The current rows of the payments that the events can touch. Their ids are found among the events and
    in the narrow tables of intent ids; then only the buckets of these ids are read."""
    spark = typed.sparkSession
    bucketed = isinstance(base, BucketedPayments)
    schema = base.columns if bucketed else columns_of(base)
    kind = next(f.split(" ", 1)[1] for f in schema.split(", ") if f.split(" ", 1)[0].strip("`") == "id")
    named, carried = touch_keys(typed, kind)
    carried = materialize(carried, "carried")
    held = base.holders(spark, carried) if bucketed else base.select("payment_intent_id", "id")
    older = before_batch > store.first_batch
    if older:
        mine = touched(carried, store.buckets)
        changes = store.changes(spark, "intents", f"payment_intent_id STRING, id {kind}", before_batch, mine)
        held = held.unionByName(changes.select("payment_intent_id", "id"))
    holding = held.join(carried, "payment_intent_id", "left_semi").select("id")
    wanted = materialize(named.unionByName(holding).distinct(), "wanted")
    stored = base.payments(spark, wanted) if bucketed else base
    names = stored.columns
    if not older:
        return stored.join(wanted, "id", "left_semi")
    changes = store.changes(spark, "payments", schema, before_batch, touched(wanted, store.buckets))
    few = changes.join(wanted, "id", "left_semi")
    latest = few.groupBy("id").agg(F.max_by(F.struct(*names), "batch").alias("new"))
    untouched = stored.join(wanted, "id", "left_semi").join(latest.select("id"), "id", "left_anti")
    return untouched.select(*names).unionByName(latest.select("new.*"))


def compact(
    base: DataFrame | BucketedPayments,
    store: WebhookStore,
    path: str,
    next_batch: int,
    spark: SparkSession | None = None,
) -> WebhookStore:
    """Write the payments as they are before ``next_batch`` as a new base at ``path``, in buckets if the
    old one is, and return the store that goes with it. Run it between batches; the stream is then started
    with both."""
    now = current_payments(base, store, next_batch, spark)
    if isinstance(base, BucketedPayments):
        write_buckets(now, path, base.buckets)
    else:
        now.write.parquet(path)
    return WebhookStore(store.root, next_batch, store.buckets)


@dataclass(frozen=True)
class Notices:
    """Tables for the notices of a stream: reservations, and details(id, title, ticket_description,
    show_date). They are joined as they are when a batch runs."""

    reservations: DataFrame
    details: DataFrame
    team: str = outbox.TEAM_SIGNATURE


def apply_webhook_stream(
    raw: DataFrame,
    base_payments: DataFrame | BucketedPayments,
    users: DataFrame,
    store: WebhookStore,
    checkpoint: str,
    as_of: datetime | str | None = None,
    split_rows: int = SPLIT_ROWS,
    notices: Notices | None = None,
    repeats_within: str | None = None,
) -> DataStreamWriter:
    """raw(seq, value), or messages of ``read_webhook_topics``, streaming. The caller sets the trigger
    and starts the writer.

    The clock is ``as_of``, or the time of a batch's last message, never that of the run. With ``notices``
    the mails that a batch calls for are written as ``outbox``. With ``repeats_within`` an event whose
    gateway id arrived already, in this batch or one up to that time before, is left out.
    """
    if as_of is None and "timestamp" not in raw.columns:
        raise ValueError("messages without a timestamp need as_of")
    if repeats_within is not None:
        raw = without_repeats(raw, repeats_within)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            now = as_of
            if now is None:
                last = batch.agg(F.max("timestamp").cast("timestamp_ntz")).first()[0]
                now = last or datetime(1970, 1, 1)
            if "seq" not in batch.columns:
                batch = number_messages(batch, batch_id)
            typed = materialize(parse_webhooks(batch), "typed")
            payments = materialize(payments_for(typed, base_payments, store, batch_id), "touched")
            result = fold_webhooks(typed, payments, users, now, split_rows=split_rows)
            changed = materialize(result.payments, "changed")
            tables = {
                "payments": with_buckets(changed, store.buckets),
                "intents": held_intents(changed, store.buckets),
            }
            for name, rows in tables.items():
                rows.write.mode("overwrite").partitionBy("bucket").parquet(store.path(name, batch_id))
            flat = {"logs": result.logs, "quarantine": result.quarantine}
            if notices is not None:
                flat["outbox"] = outbox.webhook_mails(
                    result.applied, payments, users, notices.reservations, notices.details, notices.team
                )
            for name, rows in flat.items():
                rows.write.mode("overwrite").parquet(store.path(name, batch_id))

    return raw.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
