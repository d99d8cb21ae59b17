"""Slicing a hot key changes how the work is divided and nothing else."""

import pytest
from __spark_entry__ import oracle_sql
from conftest import DATA, rows_of
from creditpath.operators import enrich, journeys, risk, visits
from creditpath.plans import queries as named_queries
from creditpath.plans import skew
from creditpath.plans.stages import Stages
from creditpath.sources.event_log import JOURNEY, ad_events
from pyspark.sql import functions as F
from tools.compare import connect, difference


@pytest.fixture(scope="module")
def plain(hot_raw):
    return ad_events(hot_raw).cache()


@pytest.fixture(scope="module")
def sliced(hot_raw):
    return ad_events(hot_raw, hot_rows=150).cache()


def test_no_slices_without_hot_keys(hot_raw, plain):
    assert not skew.is_sliced(plain)
    assert not skew.is_sliced(ad_events(hot_raw, hot_rows=4000))


def test_hot_journeys_are_cut_evenly(sliced):
    assert skew.is_sliced(sliced)
    per_slice = sliced.where("slice IS NOT NULL").groupBy(*JOURNEY, "slice").count()
    assert per_slice.select("slice").distinct().count() > 10
    assert per_slice.agg(F.max("count")).first()[0] < 400
    assert sliced.where("slice IS NOT NULL").select("user_id").distinct().collect() == [(7,)]


def test_events_are_equal(plain, sliced):
    assert rows_of(plain) == rows_of(sliced.drop("slice"))


@pytest.mark.parametrize("by", [JOURNEY, ("uid",)])
def test_ordered_operators_are_equal(plain, sliced, by):
    assert rows_of(journeys.transitions(plain, by)) == rows_of(journeys.transitions(sliced, by))
    assert rows_of(journeys.with_visit_order(plain, by)) == rows_of(
        journeys.with_visit_order(sliced, by).drop("slice")
    )
    assert rows_of(journeys.journey_ends(plain, by)) == rows_of(journeys.journey_ends(sliced, by))


@pytest.mark.parametrize("part_steps", [1, 50, 100_000])
def test_journeys_do_not_depend_on_the_slices(plain, sliced, part_steps):
    one, two = (journeys.user_journey(e, part_steps=part_steps) for e in (plain, sliced))
    assert rows_of(one) == rows_of(two)


@pytest.mark.parametrize("name", ["user_journey", "upsert", "transitions", "visit_profile", "user_risk"])
def test_sliced_queries_equal_their_sql(spark, monkeypatch, name):
    monkeypatch.setattr(skew, "MIN_HITS", 1)
    folder = f"{DATA}/sf0.001"
    stages = Stages(spark, folder, hot_rows=3)
    assert skew.is_sliced(stages.events)
    found = named_queries.rounded(getattr(named_queries, name)(stages))
    assert difference(found, connect(folder), oracle_sql()[name]) is None


def test_parts_of_a_journey_join_to_the_whole(plain, sliced):
    whole = {r.uid: r for r in journeys.user_journey(plain).collect()}
    assert {r.part for r in whole.values()} == {0}
    parts = {}
    for row in journeys.user_journey(sliced, part_steps=150).orderBy("uid", "part").collect():
        assert len(row.visiting_order) <= 150
        parts.setdefault(row.uid, []).append(row)
    assert whole.keys() == parts.keys()
    assert max(len(p) for p in parts.values()) > 5
    for uid, found in parts.items():
        assert [p.part for p in found] == list(range(len(found)))
        assert " > ".join(p.path for p in found) == whole[uid].path
        assert sum((p.visiting_order for p in found), []) == whole[uid].visiting_order
        for name in ("first_interaction", "last_interaction", "conversion"):
            assert {p[name] for p in found} == {whole[uid][name]}


def test_aggregated_operators_are_equal(plain, sliced):
    one, two = (enrich.cost_enrich(e) for e in (plain, sliced))
    assert rows_of(visits.visit_profile(one, JOURNEY)) == rows_of(visits.visit_profile(two, JOURNEY))
    assert rows_of(visits.user_totals(one, JOURNEY)) == rows_of(visits.user_totals(two, JOURNEY))
    matrices = [risk.user_transition_matrix(journeys.transitions(e, JOURNEY), JOURNEY) for e in (plain, sliced)]
    assert rows_of(matrices[0]) == rows_of(matrices[1])


def test_rows_without_a_key_are_sliced_like_any_other(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("k"), F.col("id").alias("t"), F.lit(1).alias("v")
    )
    cut = skew.split_hot_keys(rows, ["k"], ["t"], hot_rows=100)
    assert {r.k for r in cut.where("slice IS NOT NULL").select("k").distinct().collect()} == {None}
    one = skew.running_sum_before(rows, ["k"], ["t"], "v", "n")
    two = skew.running_sum_before(cut, ["k"], ["t"], "v", "n")
    assert rows_of(one) == rows_of(two.drop("slice"))


def test_sampled_cuts_give_equal_results(spark):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("t"), "id", F.lit(1).alias("v")
    )
    cuts = skew.hot_key_cuts(rows, ["k"], ["t", "id"], hot_rows=500, sample_rows=20_000)
    cut = skew.with_slices(rows, ["k"], ["t", "id"], cuts)
    assert cut.where("slice IS NOT NULL").select("k").distinct().collect() == [(1,)]
    assert cut.select("slice").distinct().count() > 10
    one = skew.running_sum_before(rows, ["k"], ["t", "id"], "v", "n")
    two = skew.running_sum_before(cut, ["k"], ["t", "id"], "v", "n")
    assert one.exceptAll(two.drop("slice")).isEmpty()
