"""Splitting hot keys for operators that need the order of rows within a key.

A window over ``key`` puts all rows of one key into one task. When a key may
hold a large part of the table, its ordered rows are cut into ``slice``s:
contiguous ranges of the order columns. Windows then run over (key, slice), and
a table with one row per slice carries totals and neighbours across the cuts.

Where the cuts lie comes from a bounded sample. The sample decides only how the
work is divided; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditpath.functions import position_in
from creditpath.plans.cuts import literal_array

# A key with more rows than this is cut; a table with fewer rows cannot hold such a key.
HOT_ROWS = 1_000_000
# Most rows drawn to find hot keys, whatever the size of the table.
SAMPLE_ROWS = 4_000_000
# Sampled rows that a key of HOT_ROWS should have, and the fewest that count as hot.
HITS, MIN_HITS = 100, 20

SLICE = "slice"


def hot_key_cuts(
    rows: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    hot_rows: int = HOT_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    total: int | None = None,
) -> Column | None:
    """The (key, order) points where hot keys are cut, sorted; None when no key is hot.

    There are at most ``sample_rows / MIN_HITS`` of them at any table size.
    ``total`` is the number of rows, or more, where that is known already.
    """
    total = rows.count() if total is None else total
    if total <= hot_rows:
        return None
    fraction = min(1.0, HITS / hot_rows, sample_rows / total)
    hits = max(MIN_HITS, int(hot_rows * fraction))
    sample = rows.select(*key, F.struct(*key, *order).alias("at"))
    if fraction < 1.0:
        sample = sample.sample(fraction=fraction, seed=17)
    seen = sample.groupBy(*key).agg(F.array_sort(F.collect_list("at")).alias("seen"))
    size = F.size("seen")
    parts = F.ceil(size / F.lit(hits)).cast("int")
    points = F.transform(
        F.sequence(F.lit(1), parts - 1),
        lambda i: F.get(F.col("seen"), F.floor(i.cast("long") * size / parts).cast("int")),
    )
    hot = seen.where(size > hits).select(F.explode(points).alias("at"))
    cuts, found = literal_array(hot.agg(F.collect_list("at").alias("cuts")))
    return cuts if found else None


def with_slices(rows: DataFrame, key: Sequence[str], order: Sequence[str], cuts: Column | None) -> DataFrame:
    """Add ``slice``: the range a row of a hot key falls in, NULL for every other key."""
    if cuts is None:
        return rows
    place = F.col(SLICE)
    same = [
        reduce(Column.__and__, [F.get(cuts, at)[name].eqNullSafe(F.col(name)) for name in key])
        for at in (place - 1, place)
    ]
    # A key is hot when a cut next to its rows belongs to it.
    hot = F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))
    placed = rows.withColumn(SLICE, position_in(cuts, F.struct(*key, *order)))
    return placed.withColumn(SLICE, F.when(hot, place))


def split_hot_keys(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``rows`` as they are when no key is hot, else with a ``slice`` column."""
    return with_slices(rows, key, order, hot_key_cuts(rows, key, order, hot_rows))


def is_sliced(rows: DataFrame) -> bool:
    return SLICE in rows.columns


def scan_key(rows: DataFrame, key: Sequence[str]) -> list[str]:
    """The columns a window over the ordered rows of ``key`` is partitioned by."""
    return [*key, SLICE] if is_sliced(rows) else list(key)


def slice_totals(rows: DataFrame, key: Sequence[str], **totals: Column) -> DataFrame:
    """Aggregates per (key, slice) of the hot keys; as few rows as there are cuts."""
    hot = rows.where(F.col(SLICE).isNotNull())
    return hot.groupBy(*key, SLICE).agg(*[column.alias(name) for name, column in totals.items()])


def join_slices(rows: DataFrame, key: Sequence[str], per_slice: DataFrame) -> DataFrame:
    """Attach to each row of a hot key what was found out about its slice; NULL for other keys."""
    by = {name: f"_of_{name}" for name in (*key, SLICE)}
    found = per_slice.withColumnsRenamed(by)
    same = [F.col(name).eqNullSafe(F.col(other)) for name, other in by.items() if name != SLICE]
    match = reduce(Column.__and__, same, F.col(SLICE) == F.col(by[SLICE]))
    return rows.join(F.broadcast(found), match, "left").drop(*by.values())


def slice_window(key: Sequence[str]) -> Window:
    """The slices of one key in order."""
    return Window.partitionBy(*key).orderBy(SLICE)


def running_sum_before(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the same key."""
    window = Window.partitionBy(*scan_key(rows, key)).orderBy(*order)
    before = F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not is_sliced(rows):
        return rows.withColumn(name, before)
    earlier = slice_window(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = slice_totals(rows, key, _sum=F.sum(value))
    totals = totals.select(*key, SLICE, F.sum("_sum").over(earlier).alias("_carry"))
    carried = join_slices(rows.withColumn(name, before), key, totals)
    return carried.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry")
