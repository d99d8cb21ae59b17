"""Journeys by pauses: brute force, and equal results when users or sessions are cut into slices."""

import datetime as dt

import pytest
from conftest import rows_of
from creditpath.operators.sessions import session_journeys, with_sessions
from creditpath.plans.skew import is_sliced
from creditpath.sources.event_log import ad_events


@pytest.fixture(scope="module")
def events(hot_raw):
    return ad_events(hot_raw).cache()


@pytest.mark.parametrize("gap", [0.5, 50, 1800])
def test_sessions_against_a_loop(events, gap):
    want, last, number = {}, {}, {}
    for r in sorted(events.collect(), key=lambda r: (r["time"], r["event_id"])):
        user = r["user_id"]
        if user in last and (r["time"] - last[user]).total_seconds() > gap:
            number[user] += 1
        last[user] = r["time"]
        want[r["event_id"]] = number.setdefault(user, 0)
    for hot_rows in (10**6, 150):
        got = {r["event_id"]: r["session"] for r in with_sessions(events, gap, hot_rows=hot_rows).collect()}
        assert got == want


@pytest.mark.parametrize("gap", [10, 86_400])
def test_hot_users_and_sessions_change_nothing(events, gap):
    assert is_sliced(with_sessions(events, 86_400, hot_rows=150))
    assert rows_of(session_journeys(events, gap)) == rows_of(session_journeys(events, gap, hot_rows=150))


def test_edges(spark):
    schema = "user_id long, event_id long, time timestamp_ntz, channel string, conversion int"
    day = dt.datetime(2024, 1, 1)
    rows = [(1, 1, None, "a", 0), (1, 2, day, "b", 0), (1, 3, day + dt.timedelta(seconds=60), "c", 1), (None, 4, day, "d", 0)]
    got = {r["event_id"]: r["session"] for r in with_sessions(spark.createDataFrame(rows, schema), 59).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}
    assert with_sessions(spark.createDataFrame([], schema)).count() == 0
