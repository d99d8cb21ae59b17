"""The chain on small graphs: the worked example, brute force and properties."""

import pytest
from creditpath.functions import path_transitions
from creditpath.functions.columns import register_sql_functions
from creditpath.operators import markov
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

EXAMPLE = [
    ("Start", "FB", 0.2), ("Start", "GD", 0.8), ("FB", "Conversion", 0.8), ("FB", "Email", 0.2),
    ("Email", "Conversion", 0.1), ("Email", "Null", 0.9), ("GD", "Conversion", 0.6), ("GD", "FB", 0.4),
]
SCHEMA = "start_state string, end_state string, transition_probability double"


def _solved(spark, edges, mode, **options):
    graphs = markov.removal_graphs(spark.createDataFrame(edges, SCHEMA))
    return markov.conversion_probability(graphs, mode, **options)


@pytest.mark.parametrize("mode", ["simple_path", "absorbing"])
def test_worked_example(spark, mode):
    solved = _solved(spark, EXAMPLE, mode)
    found = {r.removed: r.conversion_probability for r in solved.collect()}
    assert found == pytest.approx({"(none)": 0.9064, "FB": 0.48, "GD": 0.164, "Email": 0.896})
    effects = {r.channel: r.removal_effect for r in markov.removal_effect(solved).collect()}
    assert effects == {"FB": 0.47, "GD": 0.82, "Email": 0.01}


def _walk(edges, state, visited):
    total = 0.0
    for start, end, p in edges:
        if start != state or end == "Null" or end in visited:
            continue
        total += p * (1.0 if end == "Conversion" else _walk(edges, end, visited | {end}))
    return total


CHANNELS = ["a", "b", "c", "d"]


@st.composite
def graphs(draw):
    edges = []
    for start in ["Start", *CHANNELS]:
        ends = draw(st.lists(st.sampled_from([*CHANNELS, "Conversion", "Null"]), min_size=1, unique=True))
        weights = [draw(st.integers(1, 9)) for _ in ends]
        edges += [(start, e, w / sum(weights)) for e, w in zip(ends, weights)]
    return edges


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(graphs())
def test_simple_paths_by_brute_force(spark, edges):
    found = {r.removed: r.conversion_probability for r in _solved(spark, edges, "simple_path").collect()}
    for removed, p in found.items():
        cut = [(s, "Null" if e == removed else e, p) for s, e, p in edges if s != removed]
        assert p == pytest.approx(_walk(cut, "Start", {"Start"}), abs=1e-12)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(graphs())
def test_absorbing_probability_is_the_limit_of_steps(spark, edges):
    found = {r.removed: r.conversion_probability for r in _solved(spark, edges, "absorbing").collect()}
    assert all(-1e-12 <= p <= 1 + 1e-12 for p in found.values())
    mass, won = {"Start": 1.0}, 0.0
    for _ in range(4000):
        nxt = {}
        for s, e, p in edges:
            nxt[e] = nxt.get(e, 0.0) + mass.get(s, 0.0) * p
        won += nxt.pop("Conversion", 0.0)
        nxt.pop("Null", None)
        mass = nxt
    assert found["(none)"] == pytest.approx(won, abs=1e-6)
    assert all(found["(none)"] >= p - 1e-9 for p in found.values())


def test_no_conversions_gives_no_effect(spark):
    edges = [("Start", "a", 1.0), ("a", "Null", 1.0)]
    effects = markov.removal_effect(_solved(spark, edges, "simple_path"))
    assert [(r.channel, r.removal_effect) for r in effects.collect()] == [("a", None)]


def test_too_many_states_for_simple_paths(spark):
    names = [f"c{i:02}" for i in range(20)]
    edges = [("Start", names[0], 1.0)] + [(n, "Conversion", 1.0) for n in names]
    with pytest.raises(ValueError, match="absorbing"):
        _solved(spark, edges, "simple_path", max_channels=16)
    for mode in ("simple_path", "absorbing"):
        base = _solved(spark, edges, mode).where("removed = '(none)'").first()
        assert base.conversion_probability == pytest.approx(1.0)


def test_states_that_never_leave_win_nothing(spark):
    edges = [("Start", "a", 0.5), ("Start", "Conversion", 0.5), ("a", "b", 1.0), ("b", "a", 1.0)]
    base = _solved(spark, edges, "absorbing").where("removed = '(none)'").first()
    assert base.conversion_probability == pytest.approx(0.5)


PATH = (
    "Start > Affiliates > Search Engine Marketing > Affiliates > Social Network > Social Network > "
    "Social Network > Social Network > Search Engine Marketing > Null"
)


def test_transitions_of_a_path(spark):
    rows = spark.createDataFrame([(PATH,), ("Start",), (None,)], "path string")
    first, single, missing = [r[0] for r in rows.select(path_transitions(F.col("path"))).collect()]
    assert len(first) == 9 and first.count("Social Network > Social Network") == 3
    assert first[0] == "Start > Affiliates" and first[-1] == "Search Engine Marketing > Null"
    assert single == [] and not missing
    register_sql_functions(spark)
    rows.createOrReplaceTempView("paths")
    assert spark.sql("SELECT get_transition_array(path) FROM paths").first()[0] == first


def test_adjacency_lists_match(spark):
    graph = markov.removal_graphs(spark.createDataFrame(EXAMPLE, SCHEMA))
    lists = {(r.removed, r.start_state): r for r in markov.adjacency(graph).collect()}
    row = lists["FB", "GD"]
    assert list(zip(row.next_stages, row.next_stage_transition_probabilities)) == [("Conversion", 0.6), ("Null", 0.4)]
    assert ("FB", "FB") not in lists
