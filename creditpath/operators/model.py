"""The boosted-tree model of impressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditpath.plans.small import pin, pin_counted

LABEL = "impr"
SEED = 1234

# Visit columns and the names the model knows them by.
RENAMED = {
    "visit_impr": "impr",
    "sum_visit_impr": "user_visits",
    "visit_clicks": "clicks",
    "visit_txns": "txns",
    "max_cpm": "cpm",
    "avg_cpi": "cpi",
    "bid_cpc": "cpc",
}
NUMERIC = [
    "timestamp", "month", "dayofweek", "weekofyear", "product_stars",
    "user_visits", "clicks", "txns", "cpm", "cpi", "cpc", "VISIT_RANK2",
]
BINNED = [f"_bin_{name}" for name in NUMERIC]
FEATURES = [*BINNED[:4], "channelIndex", *BINNED[4:]]

# The grid searched by cross validation.
GRID_DEPTH = [2, 5, 7]
GRID_ITERATIONS = [5, 10, 15]
FOLDS = 3
# Bins of a numeric column, as many as the trees use by default, and the evenly spaced points of a column of more values
# that they are chosen from.
BINS, POINTS = 32, 1_000
# Cells of a task at least: a tree level is a short job, and there are hundreds.
PART_CELLS = 20_000


def model_input(silver: DataFrame) -> DataFrame:
    return silver.withColumnsRenamed(RENAMED)


def columns_of_type(rows: DataFrame, kind: str) -> list[str]:
    """The names of the columns of one type, such as ``string``."""
    return [name for name, dtype in rows.dtypes if dtype.startswith(kind)]


def casts() -> SQLTransformer:
    """Numbers as double with 0 for NULL; the label is left alone, so rows without one can be scored."""
    as_double = ", ".join(f"coalesce(cast({c} AS double), 0.0D) AS {c}" for c in NUMERIC)
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(NUMERIC)}), {as_double} FROM __THIS__")


def _strided(points: list[float]) -> list[float]:
    """The values that end a bin: those nearest to even shares of ``points``, in order, as the trees choose them."""
    values, ends = [], []
    for at, point in enumerate(points, 1):
        if values and values[-1] == point:
            ends[-1] = at
        else:
            values.append(point)
            ends.append(at)
    stride = target = len(points) / BINS
    chosen = []
    for value, end, following in zip(values, ends, ends[1:]):
        if len(chosen) < BINS - 1 and abs(end - target) < abs(following - target):
            chosen.append(value)
            target += stride
    return chosen


def bin_ends(rows: DataFrame) -> dict[str, list[float]]:
    """The upper ends of each numeric column's bins, the last bin's left out, from all of ``rows`` (cast).

    A column of at most ``BINS`` values has a bin for each, ended halfway to the next.
    """
    shares = [k / POINTS for k in range(1, POINTS + 1)]
    sizes = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in NUMERIC]).first()
    # The estimate of so few values is not off by half.
    few = [c for c in NUMERIC if sizes[c] <= 2 * BINS]
    sets = rows.agg(F.count(F.lit(1)), *[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first()
    many = [c for c in NUMERIC if c not in few or len(sets[c]) > BINS]
    seen = rows.agg(F.count(F.lit(1)), *[F.percentile_approx(c, shares, 10 * POINTS).alias(c) for c in many]).first()
    ends = {}
    for c in NUMERIC:
        ends[c] = _strided(seen[c] or []) if c in many else [(a + b) / 2 for a, b in zip(sets[c], sets[c][1:])]
        ends[c] = [end for end in ends[c] if math.isfinite(end)]
    return ends


def _bin_of(name: str, ends: list[float], low: int = 0) -> str:
    """The bin's number as SQL, by binary search."""
    if not ends:
        return f"{low}.0D"
    half = len(ends) // 2
    return f"IF({name} <= {ends[half]!r}D, {_bin_of(name, ends[:half], low)}, {_bin_of(name, ends[half + 1 :], low + half + 1)})"


def preparation(train: DataFrame) -> PipelineModel:
    """Stages that cast, index the channel, bin the numbers and assemble the features.

    Index and bins are fitted once; channels unseen in training share one extra index.
    """
    cast = casts()
    rows = cast.transform(train)
    channels = StringIndexer(inputCol="channel", outputCol="channelIndex", handleInvalid="keep").fit(rows)
    binned = ", ".join(f"{_bin_of(c, ends)} AS _bin_{c}" for c, ends in bin_ends(rows).items())
    bins = SQLTransformer(statement=f"SELECT *, {binned} FROM __THIS__")
    return PipelineModel(stages=[cast, channels, bins, VectorAssembler(inputCols=FEATURES, outputCol="features")])


def regressor(**settings) -> GBTRegressor:
    # The bins are made: with this bound all of them are kept, and found in up to a million cells.
    return GBTRegressor(labelCol=LABEL, featuresCol="features", weightCol="weight", seed=SEED, maxBins=1024, **settings)


def labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn(LABEL, F.col(LABEL).cast("double"))


def cells(prepared: PipelineModel, rows: DataFrame, *keys: str) -> DataFrame:
    """One row for all ``rows`` of the same features (and ``keys``): their number, mean label and its squared errors.

    Trees see the bins only, and squared errors inside a cell are the same on both sides of
    every split, so a fit on weighted cells is that on the rows.
    """
    found = PipelineModel(stages=prepared.stages[:-1]).transform(labelled(rows)).groupBy(*keys, *FEATURES)
    told = F.count(LABEL)
    found = found.agg(
        told.cast("double").alias("weight"), F.avg(LABEL).alias(LABEL), (F.var_pop(LABEL) * told).alias("inside")
    )
    pinned, n_cells = pin_counted(prepared.stages[-1].transform(found.where("weight > 0")).drop(*FEATURES))
    return pinned.coalesce(n_cells // PART_CELLS + 1)


def errors_by_iteration(model: GBTRegressionModel, found: DataFrame) -> list[float]:
    """Root mean squared error on the rows of the cells ``found`` after each tree of ``model``."""
    total = found.agg(F.sum("inside") / F.sum("weight")).first()[0]
    if total is None:
        return [math.nan] * model.getNumTrees
    return [math.sqrt(error + total) for error in model.evaluateEachIteration(found, "squared")]


def fit(train: DataFrame) -> PipelineModel:
    """Preparation and trees with default settings, as one pipeline."""
    prepared = preparation(train)
    return PipelineModel(stages=[*prepared.stages, regressor().fit(cells(prepared, train))])


@dataclass(frozen=True)
class Tuned:
    model: GBTRegressionModel
    points: list[dict]


def tune(found: DataFrame, depths=tuple(GRID_DEPTH), iterations=tuple(GRID_ITERATIONS), parallelism: int = 8) -> Tuned:
    """Cross validation over the grid, on cells by ``fold``.

    Trees are added one by one, so the first ones of the longest fit are each shorter fit.
    """

    def searched(task: tuple[int, int]) -> list[float]:
        depth, fold = task
        model = regressor(maxDepth=depth, maxIter=max(iterations)).fit(found.where(F.col("fold") != fold))
        return errors_by_iteration(model, found.where(F.col("fold") == fold))

    tasks = [(depth, fold) for depth in sorted(depths, reverse=True) for fold in range(FOLDS)]
    with ThreadPool(parallelism) as pool:
        errors = dict(zip(tasks, pool.map(inheritable_thread_target(found.sparkSession)(searched), tasks, chunksize=1)))
    points = [
        {"max_depth": d, "max_iter": n, "rmse": sum(errors[d, k][n - 1] for k in range(FOLDS)) / FOLDS}
        for d in depths
        for n in iterations
    ]
    best = min(points, key=lambda p: p["rmse"])
    return Tuned(regressor(maxDepth=best["max_depth"], maxIter=best["max_iter"]).fit(found), points)


def predict_impressions(model: PipelineModel, silver: DataFrame, name: str = "impr_hat") -> DataFrame:
    """Silver visits with the predicted impressions, for scoring bid units on predictions."""
    scored = model.transform(model_input(silver).withColumn("_channel", F.col("channel")))
    back = {new: old for old, new in RENAMED.items()}
    kept = scored.drop("features", "channelIndex", "_channel", *BINNED).withColumnRenamed("prediction", name)
    return kept.withColumnsRenamed(back)


def model_report(train: DataFrame, test: DataFrame, **grid) -> DataFrame:
    """Errors of the default and the tuned model on train and test rows, and of each grid point.

    The rows are read a few times, for bins and cells; all trees are fitted and judged on the cells.
    """
    columns = [*NUMERIC, "channel", LABEL]
    train, test = pin(model_input(train).select(*columns)), model_input(test).select(*columns)
    prepared = preparation(train)
    by_fold = cells(prepared, train.withColumn("fold", F.floor(F.rand(SEED) * FOLDS)), "fold")
    parts = {"train": by_fold, "test": cells(prepared, test)}
    with ThreadPool(1) as beside:
        default = beside.apply_async(inheritable_thread_target(train.sparkSession)(regressor().fit), (by_fold,))
        tuned = tune(by_fold, **grid)
        models = {"default": default.get(), "tuned": tuned.model}
    lines = [
        (stage, part, None, None, errors_by_iteration(fitted, found)[-1])
        for stage, fitted in models.items()
        for part, found in parts.items()
    ]
    lines += [("grid", "folds", p["max_depth"], p["max_iter"], float(p["rmse"])) for p in tuned.points]
    schema = "stage string, part string, max_depth int, max_iter int, rmse double"
    return train.sparkSession.createDataFrame(lines, schema)
