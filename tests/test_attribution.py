"""Multi-touch and Shapley credit: brute force, hot journeys, properties."""

import datetime as dt
import itertools
import math
import random

import pytest
from conftest import rows_of
from creditpath.operators.shapley import TooManyChannelsError, shapley
from creditpath.operators.touches import multi_touch, touch_weights
from creditpath.sources.event_log import JOURNEY, ad_events

SCHEMA = "uid string, event_id long, time timestamp_ntz, channel string, conversion int"
DAY = dt.datetime(2024, 1, 1)


def some_events(n_journeys=60, channels="abcd", seed=3, spread=20_000):
    rng = random.Random(seed)
    rows, at = [], 0
    for j in range(n_journeys):
        for _ in range(rng.randrange(1, 9)):
            at += 1
            time = DAY + dt.timedelta(seconds=rng.randrange(spread))
            rows.append((f"u{j}", at, time, rng.choice(channels), int(rng.random() < 0.4)))
    return rows


def journeys_of(rows):
    found = {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        found.setdefault(row[0], []).append(row)
    return found


def test_multi_touch_against_brute_force(spark):
    rows = some_events()
    want = {}
    for events in journeys_of(rows).values():
        if events[-1][4] != 1:
            continue
        weights = [0.5 ** ((events[-1][2] - e[2]).total_seconds() / 3600) for e in events]
        for e, w in zip(events, weights):
            want["linear", e[3]] = want.get(("linear", e[3]), 0) + 1 / len(events)
            want["time_decay", e[3]] = want.get(("time_decay", e[3]), 0) + w / sum(weights)
    got = multi_touch(spark.createDataFrame(rows, SCHEMA), half_life=3600).collect()
    assert {(r[0], r[1]) for r in got} == set(want)
    totals = {m: sum(v for (n, _), v in want.items() if n == m) for m, _ in want}
    for r in got:
        assert math.isclose(r["conversions"], want[r["attribution_model"], r["channel"]], rel_tol=1e-12)
        assert math.isclose(r["share"], r["conversions"] / totals[r["attribution_model"]], rel_tol=1e-12)


@pytest.mark.parametrize("half_life", [60, 86_400])
def test_credit_of_hot_journeys_is_equal(hot_raw, half_life):
    plain, sliced = ad_events(hot_raw).cache(), ad_events(hot_raw, hot_rows=150).cache()
    one, two = (touch_weights(e, JOURNEY, half_life=half_life) for e in (plain, sliced))
    assert rows_of(one) == rows_of(two)
    sums = two.groupBy(*JOURNEY).agg({"linear": "sum", "time_decay": "sum"}).collect()
    assert sums and all(math.isclose(v, 1, rel_tol=1e-9) for r in sums for v in r[len(JOURNEY) :])


def test_old_touches_fade_without_underflow(spark):
    far = [("u", 1, DAY, "a", 0), ("u", 2, DAY + dt.timedelta(days=3000), "b", 1)]
    got = {r["channel"]: r["time_decay"] for r in touch_weights(spark.createDataFrame(far, SCHEMA), half_life=1).collect()}
    assert got == {"a": 0.0, "b": 1.0}
    none = [("u", 1, None, "a", 0), ("u", 2, DAY, "b", 1), ("v", 3, None, "a", 1)]
    got = {(r["uid"], r["channel"]): r["time_decay"] for r in touch_weights(spark.createDataFrame(none, SCHEMA)).collect()}
    assert got == {("u", "a"): 0.0, ("u", "b"): 1.0, ("v", "a"): None}
    assert multi_touch(spark.createDataFrame([], SCHEMA)).collect() == []


def by_orders(rows, channels, rate):
    """Shapley values from their definition: the mean gain over all orders of the channels."""
    sets = [({e[3] for e in events}, events[-1][4]) for events in journeys_of(rows).values()]

    def worth(part):
        inside = [won for touched, won in sets if touched <= part]
        return (sum(inside) / len(inside) if inside else 0.0) if rate else float(sum(inside))

    credit = dict.fromkeys(channels, 0.0)
    orders = list(itertools.permutations(channels))
    for order in orders:
        for i, channel in enumerate(order):
            credit[channel] += (worth({*order[: i + 1]}) - worth({*order[:i]})) / len(orders)
    return credit


@pytest.mark.parametrize("value", ["conversions", "rate"])
@pytest.mark.parametrize("channels", ["a", "ab", "abcde"])
def test_shapley_against_all_orders(spark, value, channels):
    rows = some_events(channels=channels)
    want = by_orders(rows, channels, value == "rate")
    got = {r["channel"]: r for r in shapley(spark.createDataFrame(rows, SCHEMA), value=value).collect()}
    assert set(got) == set(channels)
    for channel in channels:
        assert math.isclose(got[channel]["credit"], want[channel], rel_tol=1e-9, abs_tol=1e-12)
    # Efficiency: the credits add up to the worth of all channels.
    ends = [events[-1][4] for events in journeys_of(rows).values()]
    total = sum(ends) / (len(ends) if value == "rate" else 1)
    assert math.isclose(sum(r["credit"] for r in got.values()), total, rel_tol=1e-9)
    assert math.isclose(sum(r["share"] for r in got.values()), 1, rel_tol=1e-9)


def test_shapley_symmetry_and_idle_channel(spark):
    rows = [("u", 1, DAY, "a", 0), ("u", 2, DAY, "b", 1), ("v", 3, DAY, "c", 0), ("w", 4, DAY, None, 1)]
    got = {r["channel"]: r["credit"] for r in shapley(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == pytest.approx({"a": 0.5, "b": 0.5, "c": 0.0})


def test_too_many_channels_are_an_error(spark):
    rows = spark.createDataFrame([("u", i, DAY, f"c{i}", 0) for i in range(7)], SCHEMA)
    with pytest.raises(TooManyChannelsError):
        shapley(rows, max_channels=6)
    assert shapley(rows, max_channels=7).count() == 7
