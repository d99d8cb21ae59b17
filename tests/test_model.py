"""The trees of impressions are fitted on cells of equal binned features."""

import math

import pytest
from creditpath.operators import model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F


def visits_like(spark, n, copies=1):
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    numbers = {c: (F.xxhash64("id", F.lit(c)) % 6).cast("long") for c in model.NUMERIC}
    rows = rows.withColumns(numbers).withColumn("channel", F.concat(F.lit("c"), (F.col("id") % 4).cast("string")))
    label = F.col("clicks") * F.col("txns") + F.col("cpm") + F.when(F.col("channel") == "c1", 5).otherwise(0) + F.col("copy") % 3
    return rows.withColumn(model.LABEL, label.cast("double"))


def test_trees_on_cells_are_the_trees_on_rows(spark):
    rows = visits_like(spark, 400, copies=4).cache()
    prepared = model.preparation(rows)
    found = model.cells(prepared, rows)
    assert found.count() == 400 and found.agg(F.sum("weight")).first()[0] == 1600
    errors = model.errors_by_iteration(model.regressor(maxDepth=3, maxIter=4).fit(found), found)

    plain = StringIndexer(inputCol="channel", outputCol="channelIndex", handleInvalid="keep").fit(rows).transform(rows)
    inputs = [c.removeprefix("_bin_") for c in model.FEATURES]
    plain = VectorAssembler(inputCols=inputs, outputCol="features").transform(plain)
    judge = RegressionEvaluator(metricName="rmse", labelCol=model.LABEL)
    for n in (2, 4):
        trees = GBTRegressor(labelCol=model.LABEL, maxDepth=3, maxIter=n, seed=model.SEED).fit(plain)
        assert judge.evaluate(trees.transform(plain)) == pytest.approx(errors[n - 1], abs=1e-9)


def test_repeated_rows_make_no_more_cells(spark):
    once, often = visits_like(spark, 300), visits_like(spark, 300, copies=20)
    prepared = model.preparation(once)
    assert model.cells(prepared, once).count() == model.cells(prepared, often).count() == 300


def test_bins_come_from_all_rows(spark):
    rows = visits_like(spark, 60_000).withColumn("timestamp", F.col("id").cast("double"))
    rows = rows.withColumn("cpc", F.when(F.col("id") == 59_999, 9.0).otherwise(1.0))
    ends = model.bin_ends(model.casts().transform(rows))
    assert ends["cpc"] == [5.0] and len(ends["timestamp"]) == model.BINS - 1
    assert all(abs(end - 60_000 * k / model.BINS) <= 100 for k, end in enumerate(ends["timestamp"], 1))
    few = model.bin_ends(model.casts().transform(rows.where("id < 0")))
    assert all(found == [] for found in few.values())


def test_a_model_without_rows_to_judge_has_no_error(spark):
    rows = visits_like(spark, 100)
    prepared = model.preparation(rows)
    fitted = model.regressor(maxDepth=2, maxIter=2).fit(model.cells(prepared, rows))
    assert all(math.isnan(e) for e in model.errors_by_iteration(fitted, model.cells(prepared, rows.where("id < 0"))))
