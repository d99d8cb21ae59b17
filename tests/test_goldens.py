"""Known numbers of the sf0.01 events."""

import pytest
from conftest import DATA
from creditpath.operators import journeys, risk
from creditpath.plans.stages import Stages, named
from creditpath.sources.event_log import JOURNEY
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark):
    return Stages(spark, f"{DATA}/sf0.01")


def test_event_log(stages):
    row = stages.events.agg(
        F.count("*"), F.count_distinct("uid"), F.sum("conversion"), F.sum("click")
    ).first()
    assert tuple(row) == (10000, 5157, 1981, 3987)
    assert stages.ends.agg(F.max("n_events")).first()[0] == 8
    per_channel = {r[0]: r[1] for r in stages.events.groupBy("channel").count().collect()}
    assert per_channel == {
        "Social Network": 2015, "Search Engine Marketing": 2924, "Google Display Network": 1529,
        "Affiliates": 2993, "Email": 539,
    }


def test_touch(stages):
    found = {(r.attribution_model, r.channel): r.attribution_percent for r in stages.touch.collect()}
    first = {"Affiliates": 0.31, "Email": 0.06, "Google Display Network": 0.15, "Search Engine Marketing": 0.29, "Social Network": 0.19}
    last = first | {"Affiliates": 0.29, "Social Network": 0.21}
    assert found == {("first_touch", c): v for c, v in first.items()} | {("last_touch", c): v for c, v in last.items()}


def test_matrix(stages):
    assert stages.transitions.count() == 15157
    assert stages.matrix.count() == 40
    sums = stages.matrix.groupBy("start_state").agg(F.sum("transition_probability").alias("s")).collect()
    assert len(sums) == 6 and all(abs(r.s - 1) < 1e-12 for r in sums)


@pytest.mark.parametrize(
    "mode, base, effects",
    [
        ("simple_path", 0.292141, [0.3954, 0.0976, 0.2294, 0.3895, 0.2965]),
        ("absorbing", 1981 / 5157, [0.4479, 0.1048, 0.2570, 0.4418, 0.3338]),
    ],
)
def test_removal_effect(stages, mode, base, effects):
    p = {r.removed: r.conversion_probability for r in stages.conversion_probability(mode).collect()}
    assert p["(none)"] == pytest.approx(base, abs=1e-6)
    found = [r.effect for r in stages.removal_effect(mode).orderBy("channel").collect()]
    assert found == pytest.approx(effects, abs=5e-5)


def test_browse_probability_equals_its_long_form(stages):
    exposure = risk.state_exposure(stages.probabilities, JOURNEY)
    long = named(risk.browse_by_state(exposure, JOURNEY)).groupBy("uid").agg(F.sum("to_browse").alias("long"))
    both = named(stages.browse).join(long, "uid", "full")
    assert both.count() == 3856
    assert both.where("prob_to_browse IS NULL OR long IS NULL OR abs(prob_to_browse - long) > 1e-12").isEmpty()


def test_paths_hold_the_states_in_order(stages):
    journey = named(journeys.user_journey(stages.events, JOURNEY))
    lengths = journey.select(F.size(F.split("path", " > ")).alias("n"), F.size("visiting_order").alias("v"))
    assert lengths.where("n <> v + 2").isEmpty()
    assert journey.where(~F.col("path").rlike("^Start > .* > (Conversion|Null)$")).isEmpty()
