"""Global ranks and the greedy prefix against plain windows and brute force."""

import itertools

import pytest
from conftest import rows_of
from creditpath.functions import tile_of_row
from creditpath.operators import allocation
from creditpath.plans import ranges
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize("n, tiles, distinct", [(1, 10, 1), (7, 10, 3), (1000, 100, 4), (1234, 10, 1), (5000, 100, 5000)])
def test_ntile_equals_the_window(spark, n, tiles, distinct):
    rows = spark.range(n).select("id", (F.col("id") * 7919 % distinct).alias("v"))
    found = ranges.ntile(rows, tiles, {"v": F.col("v"), "id": F.col("id")}, "tile")
    want = rows.withColumn("tile", F.ntile(tiles).over(Window.orderBy("v", "id")))
    assert rows_of(found) == rows_of(want)


def test_ntile_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SAMPLE_ROWS", 500)
    monkeypatch.setattr(ranges, "MIN_BUCKETS", 64)
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("v"))
    found = ranges.ntile(rows, 10, {"v": -F.col("v"), "id": F.col("id").cast("string")}, "tile")
    want = rows.withColumn("tile", F.ntile(10).over(Window.orderBy(-F.col("v"), F.col("id").cast("string"))))
    assert found.exceptAll(want).isEmpty() and found.count() == 20_000


def test_ntile_of_nothing(spark):
    rows = spark.range(0).withColumn("v", F.col("id"))
    assert ranges.ntile(rows, 10, {"v": F.col("v")}, "tile").collect() == []


def test_tile_formula(spark):
    cases = spark.range(1, 60).crossJoin(spark.range(1, 60).withColumnRenamed("id", "n")).where("id <= n")
    for tiles in (1, 3, 10, 70):
        made = cases.withColumn("t", tile_of_row(F.col("id"), F.col("n"), tiles))
        want = F.ntile(tiles).over(Window.partitionBy("n").orderBy("id"))
        assert made.withColumn("w", want).where("t <> w OR t IS NULL").isEmpty()


def _units(spark, units):
    rows = [(i, float(spend), float(revenue), float(revenue)) for i, (spend, revenue) in enumerate(units)]
    return spark.createDataFrame(rows, "id int, spend double, revenue double, value double")


def _best(units, target):
    """The best objective over all choices of whole units plus at most one fraction."""
    w = [s - r / target for s, r in units]
    best = 0.0
    for whole in itertools.product((0, 1), repeat=len(units)):
        load = sum(a * b for a, b in zip(whole, w))
        value = sum(a * r for a, (_, r) in zip(whole, units))
        if load <= 1e-9:
            best = max(best, value)
        for i, taken in enumerate(whole):
            if taken or w[i] <= 0 or load > 0:
                continue
            best = max(best, value + units[i][1] * min(1.0, -load / w[i]))
    return best


@SLOW
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=7))
def test_allocation_is_feasible_and_best(spark, units):
    made = allocation.allocate(_units(spark, units), F.col("value"), 0.7, ["id"]).collect()
    assert len(made) == len(units)
    assert all(0 <= r.x <= 1 for r in made)
    assert sum(r.x * r.w for r in made) <= 1e-6
    assert sum(r.x * r.v for r in made) == pytest.approx(_best(units, 0.7), abs=1e-6)


@pytest.mark.parametrize(
    "units, shares",
    [
        ([(10, 10), (20, 28)], [1, 1]),  # all relax the constraint
        ([(20, 7), (30, 7)], [0, 0]),  # none does, so there is no room
        ([(0, 7), (20, 7), (20, 0)], [1, 1, 0]),  # the room fits one unit exactly, nothing is gained by the last
    ],
)
def test_allocation_edges(spark, units, shares):
    made = allocation.allocate(_units(spark, units), F.col("value"), 0.7, ["id"]).orderBy("id").collect()
    assert [r.x for r in made] == pytest.approx(shares)
    assert [r.opt_result for r in made] == shares


def test_negative_values_are_refused(spark):
    with pytest.raises(allocation.NegativeValueError):
        allocation.allocate(_units(spark, [(1, 1)]), -F.col("value"), 0.7, ["id"])
