"""Event search: text in any of three columns, shows inside a date range."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, time

from pyspark.sql import DataFrame, functions as F

from boxoffice.functions import columns as c


def search_pattern(query: str | None) -> str:
    """The LIKE pattern of a query. % and _ in it act as wildcards; a backslash before any other
    character just means that character."""
    if not (query or "").strip():
        return "%%"
    keep = r"%_" + "\\"
    pattern = f"%{query.lower()}%"
    return re.sub(
        r"\\(.)", lambda m: m[0] if m[1] in keep else m[1], pattern, flags=re.DOTALL
    )


def search_bounds(
    start: str | None, end: str | None, as_of: datetime
) -> tuple[datetime, datetime]:
    """Blank start: today 00:00. Blank end: last second of this month. Given dates run from
    00:00 to 23:59:00 of the day."""
    today = as_of.date()
    if (start or "").strip():
        first = _day(start, "start")
    else:
        first = datetime.combine(today, time())
    if (end or "").strip():
        last = _day(end, "end").replace(hour=23, minute=59)
    else:
        month_end = today.replace(day=monthrange(today.year, today.month)[1])
        last = datetime.combine(month_end, time(23, 59, 59))
    return first, last


def _day(text: str, which: str) -> datetime:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"invalid {which} show date format")
    try:
        return datetime.strptime(text, "%Y-%m-%d")
    except ValueError:
        raise ValueError(f"invalid {which} show date format") from None


def search_events(
    events: DataFrame,
    event_details: DataFrame,
    as_of: datetime,
    query: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """The bounds and the pattern are literals, so both filters reach their scan. The filter on
    the show date makes the left join an inner one; it is written as such."""
    pattern = search_pattern(query)
    first, last = search_bounds(start, end, as_of)
    shows = event_details.filter(
        F.col("show_date").between(c.ntz(first), c.ntz(last))
    ).select(
        "event_id",
        F.col("id").alias("event_detail_id"),
        "show_date",
        "price",
        "number_of_tickets",
        "ticket_description",
    )
    hits = events.filter(
        F.lower("title").like(pattern)
        | F.lower("description").like(pattern)
        | F.lower("organizer").like(pattern)
    ).select(F.col("id").alias("event_id"), "title", "description", "organizer")
    return hits.join(shows, "event_id")
