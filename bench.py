"""Time the headline queries. BENCH_SF_DIR: the data, BENCH_CPUS: the cores, BENCH_QUERIES: other
names, with commas, or "all" for every registered query.

Each query is planned and run once in full, its rows going to the no-op sink. One warm-up query
runs first, untimed. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import time

from boxoffice.plans.queries import QUERIES
from boxoffice.session import local_session


HEADLINE = (
    "search_events",
    "search_events_dates",
    "user_events",
    "user_payments",
    "payment_by_intent",
    "reservations_by_payment",
    "details_with_title",
    "payment_reservation_details",
    "events_with_tickets",
    "event_refund_totals",
    "detail_refund_totals",
    "tickets_per_payment",
    "confirmed_attendees",
    "registration_quality",
    "event_detail_intake",
    "request_intake",
    "payment_log_append",
    "reserve_single",
    "restore_and_delete_details",
    "refund_and_restore_reservations",
    "update_event",
    "update_payment",
    "delete_event_cascade",
    "quote_requests",
    "allocate_requests",
    "post_charge_status",
    "payment_retry",
    "customer_refund",
    "event_cancel_plan",
    "detail_cancel_plan",
    "webhook_fold_payments",
    "webhook_logs",
    "notify_confirmed",
    "notify_event_updated",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if picked == "all" else picked.split(",") if picked else list(HEADLINE)
    spark = local_session(cpus, "bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("event_refund_totals")
    seconds = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
