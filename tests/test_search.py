from datetime import datetime

import pytest

from boxoffice.operators.search import search_bounds, search_events, search_pattern
from boxoffice.operators.lookups import detail_by_id, events_with_tickets, user_by_email, user_events
from boxoffice.operators.aggregates import nest_tickets
from boxoffice.sources import schemas
from tests.conftest import rows

NOW = datetime(2024, 2, 10, 15, 30)
T = datetime


@pytest.fixture
def events(table):
    return table(
        schemas.EVENTS,
        ("e1", "Rock Night", "loud", None, NOW, None, "u1"),
        ("e2", "Jazz", "calm 100% fun", "Rocky", NOW, None, "u1"),
        ("e3", "Empty rock", "no tickets", "Org", NOW, None, "u2"),
    )


@pytest.fixture
def details(table):
    def row(i, when, event):
        return (i, when, 10, 5, 4, "tier", NOW, None, event)

    from decimal import Decimal

    raw = [
        row("d1", T(2024, 2, 10), "e1"),
        row("d2", T(2024, 2, 29, 23, 59, 59), "e1"),
        row("d3", T(2024, 3, 1), "e2"),
        row("d4", T(2024, 3, 5, 23, 59, 0), "e2"),
        row("d5", T(2024, 3, 5, 23, 59, 30), "e2"),
        row("d6", T(2024, 2, 9, 23, 59), "e2"),
    ]
    return table(schemas.EVENT_DETAILS, *[(a, b, Decimal(c), *z) for a, b, c, *z in raw])


def found(df):
    return {r[0] for r in rows(df, "event_detail_id")}


def test_default_bounds(events, details):
    assert search_bounds("", " ", NOW) == (T(2024, 2, 10), T(2024, 2, 29, 23, 59, 59))
    assert found(search_events(events, details, NOW)) == {"d1", "d2"}


def test_given_end_stops_at_the_minute(events, details):
    got = search_events(events, details, NOW, None, "2024-03-01", "2024-03-05")
    assert found(got) == {"d3", "d4"}


def test_null_organizer_does_not_hide_other_columns(events, details):
    got = search_events(events, details, NOW, "ROCK", "2024-01-01", "2024-12-31")
    assert found(got) == {"d1", "d2", "d3", "d4", "d5", "d6"}
    assert found(search_events(events, details, NOW, "night", "2024-01-01", "2024-12-31")) == {
        "d1", "d2"
    }


def test_wildcards_of_the_user(events, details):
    got = search_events(events, details, NOW, "j_zz", "2024-03-01", "2024-03-05")
    assert found(got) == {"d3", "d4"}
    assert search_pattern("a\\b") == "%ab%"
    assert search_pattern("a\\%b") == "%a\\%b%"
    assert found(search_events(events, details, NOW, "100\\%", "2024-03-01", "2024-03-05")) == {
        "d3", "d4"
    }


@pytest.mark.parametrize("bad", ["2024-13-01", "01-01-2024", "2024-1-1", "x"])
def test_bad_dates(bad):
    with pytest.raises(ValueError, match="invalid start"):
        search_bounds(bad, "", NOW)
    with pytest.raises(ValueError, match="invalid end"):
        search_bounds("", bad, NOW)


def test_lookup_keeps_unmatched_keys(table, events):
    got = user_events(table("user_id STRING", ("u1",), ("nobody",)), events)
    assert rows(got, "user_id", "id", "found") == {
        ("u1", "e1", True), ("u1", "e2", True), ("nobody", None, False)
    }


def test_user_lookup_is_case_sensitive_and_drops_the_password(table):
    users = table(schemas.USERS, ("u1", "A", "B", "a@x.com", "secret", NOW, None))
    got = user_by_email(table("email STRING", ("a@x.com",), ("A@x.com",)), users)
    assert "password" not in got.columns
    assert rows(got, "email", "found") == {("a@x.com", True), ("A@x.com", False)}


def test_nested_tickets(events, details):
    got = nest_tickets(events_with_tickets(events.select("id", "title"), details))
    lists = {r.event_id: [t.id for t in r.tickets] for r in got.collect()}
    assert lists == {"e1": ["d1", "d2"], "e2": ["d3", "d4", "d5", "d6"], "e3": []}
    assert {t.tickets_remaining for r in got.collect() for t in r.tickets} == {4}


def test_lookups_broadcast_no_table(spark, capsys):
    """A table's compressed files can be a hundredth of the rows that would pass through the driver."""
    details = spark.range(6).selectExpr("id", "id * 2 as event_id")
    keys = spark.createDataFrame([(1,), (5,), (-1,), (5,), (None,)], "id long")
    got = detail_by_id(keys, details)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2, True), (5, 10, True), (5, 10, True), (-1, None, False), (None, None, False)], key=str)
    got.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
