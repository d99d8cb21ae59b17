"""Global order without a single-task window: range buckets, NTILE and the greedy prefix.

The rows are cut into buckets by boundaries from a bounded sample of the sort
key. Bucket totals (one row each) give every bucket its offset in the global
order. Only buckets that an answer changes inside of need their rows ordered.
The sort key must be unique, so that a value shared by many rows is still cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditpath.functions import position_in, tile_of_row
from creditpath.plans.cuts import literal_array
from creditpath.plans.small import pin_counted, settle

# Rows per bucket to aim for, and how many buckets there may be.
BUCKET_ROWS = 50_000
MIN_BUCKETS, MAX_BUCKETS = 16, 4096
SAMPLE_ROWS = 200_000
BUCKET = "_bucket"


def with_buckets(rows: DataFrame, total: int, order: dict[str, Column]) -> DataFrame:
    """Add a bucket number that rises with the sort key ``order`` of the ``total`` rows.

    ``rows`` must be pinned or read from a table: it is read more than once.
    """
    buckets = max(MIN_BUCKETS, min(MAX_BUCKETS, total // BUCKET_ROWS))
    point = F.struct(*[column.alias(name) for name, column in order.items()])
    fraction = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = rows.select(point.alias("at"))
    if fraction < 1.0:
        sample = sample.sample(fraction=fraction, seed=29)
    seen = sample.agg(F.array_sort(F.collect_list("at")).alias("seen"))
    step = F.transform(
        F.sequence(F.lit(1), F.lit(buckets - 1)),
        lambda i: F.get(F.col("seen"), F.floor(i.cast("long") * F.size("seen") / F.lit(buckets)).cast("int")),
    )
    bounds, _ = literal_array(seen.select(F.filter(step, lambda at: at.isNotNull()).alias("bounds")))
    return rows.withColumn(BUCKET, position_in(bounds, point))


def ntile(rows: DataFrame, tiles: int, order: dict[str, Column], name: str) -> DataFrame:
    """Add ``NTILE(tiles)`` in ascending ``order``."""
    rows, total = pin_counted(rows)
    placed = with_buckets(rows, total, order)
    totals = placed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    n_rows = F.lit(total).cast("long")
    totals = totals.select(
        BUCKET,
        "_offset",
        tile_of_row(F.col("_offset") + 1, n_rows, tiles).alias("_low"),
        tile_of_row(F.col("_offset") + F.col("_n"), n_rows, tiles).alias("_high"),
    )
    totals = settle(totals)
    found = placed.join(F.broadcast(totals), BUCKET)
    inside = found.where("_low = _high").withColumn(name, F.col("_low"))
    window = Window.partitionBy(BUCKET).orderBy(*order.values())
    place = F.col("_offset") + F.row_number().over(window)
    split = found.where("_low < _high").withColumn(name, tile_of_row(place, n_rows, tiles))
    return inside.unionByName(split).drop(BUCKET, "_offset", "_low", "_high")


def share_within(
    rows: DataFrame, total: int, order: dict[str, Column], weight: str, capacity: Column, name: str
) -> DataFrame:
    """Add the share of each row's ``weight`` that fits when rows are taken in ``order``
    until ``capacity`` is used up: 1, then one fraction, then 0. Weights must be positive,
    and ``rows``, of about ``total`` rows, pinned.
    """
    placed = with_buckets(rows, total, order)
    totals = placed.groupBy(BUCKET).agg(F.sum(weight).alias("_sum"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = settle(totals.select(BUCKET, "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_used")))
    found = placed.join(F.broadcast(totals), BUCKET).withColumn("_room", capacity)
    whole = found.where("_used + _sum <= _room").withColumn(name, F.lit(1.0))
    none = found.where("_used >= _room").withColumn(name, F.lit(0.0))
    window = Window.partitionBy(BUCKET).orderBy(*order.values()).rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("_room") - F.col("_used") - (F.sum(weight).over(window) - F.col(weight))
    fits = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / F.col(weight)))
    split = found.where("_used < _room AND _used + _sum > _room").withColumn(name, fits)
    return whole.unionByName(none).unionByName(split).drop(BUCKET, "_sum", "_used", "_room")
