"""Column expressions shared by the operators. All are built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from creditpath import fixed_values as fv

# Binary-search strides, and how many boundaries they can search.
_STRIDES = [1 << b for b in range(17, -1, -1)]
MAX_BOUNDS = sum(_STRIDES)


def hash01(key: Column, salt: str) -> Column:
    """A number in [0, 1) fixed by ``key``: the draw that replaces an unseeded random."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("|" + salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator, also under ANSI mode."""
    return F.try_divide(numerator, denominator)


def exact_sum(name: str) -> Column:
    """The sum of amounts at 12 decimals, whatever the order of the additions."""
    return F.sum(F.col(name).cast("decimal(28,12)")).cast("double")


def exact_mean(name: str) -> Column:
    """:func:`exact_sum` over the number of amounts: one division; NULL for none."""
    return ratio(exact_sum(name), F.count(name))


def lookup(key: Column, table: Mapping) -> Column:
    """The value of ``key`` in a small literal table, NULL when it is missing."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)


def ctr_of_rank(rank: Column) -> Column:
    """Click-through rate of a position: falls off as a Gaussian of the scaled rank."""
    scaled = rank * F.lit(fv.CTR_WIDTH) / F.lit(float(fv.CTR_RANKS - 1))
    return F.lit(fv.CTR_TOP) * F.round(F.exp(-scaled * scaled), 2)


def like_of_stars(stars: Column) -> Column:
    """Share of likes by product stars; the top product is nearest the peak of the curve."""
    scaled = (F.lit(fv.STARS + 1) - stars) * F.lit(fv.LIKE_WIDTH) / F.lit(float(fv.STARS))
    return F.round(F.exp(-scaled * scaled), 2)


def calendar_features(time: Column) -> dict[str, Column]:
    """Month, day of week (Sunday is 1), ISO week and unix seconds of a timestamp."""
    return {
        "month": F.month(time),
        "dayofweek": F.dayofweek(time),
        "weekofyear": F.weekofyear(time),
        "timestamp": F.unix_timestamp(time),
    }


def path_transitions(path: Column) -> Column:
    """The consecutive state pairs ``'a > b'`` of a path ``'a > b > c'``."""
    states = F.transform(F.split(path, ">"), lambda state: F.trim(state))
    pairs = F.zip_with(
        F.slice(states, F.lit(1), F.size(states) - 1),
        F.slice(states, F.lit(2), F.size(states) - 1),
        lambda a, b: F.concat(a, F.lit(" > "), b),
    )
    return F.when(F.size(states) > 1, pairs).otherwise(F.array().cast("array<string>"))


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``get_transition_array(path)`` callable from SQL, as a SQL function without Python."""
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION get_transition_array(path STRING)
        RETURNS ARRAY<STRING>
        RETURN zip_with(
            slice(transform(split(path, '>'), s -> trim(s)), 1, greatest(size(split(path, '>')) - 1, 0)),
            slice(transform(split(path, '>'), s -> trim(s)), 2, greatest(size(split(path, '>')) - 1, 0)),
            (a, b) -> concat(a, ' > ', b))
        """
    )


def position_in(bounds: Column, value: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, by binary search."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in _STRIDES]),
        F.lit(0),
        lambda at, stride: F.when(
            (at + stride <= F.size(bounds)) & (F.get(bounds, at + stride - 1) <= value), at + stride
        ).otherwise(at),
    )


def tile_of_row(row: Column, n_rows: Column, tiles: int) -> Column:
    """The NTILE bucket of the ``row``-th of ``n_rows`` ordered rows."""
    small = F.floor(n_rows / F.lit(tiles)).cast("long")
    wide = n_rows - small * F.lit(tiles)
    edge = wide * (small + 1)
    in_wide = F.ceil(row / (small + 1))
    in_small = wide + F.ceil(F.try_divide(row - edge, small))
    return F.when(row <= edge, in_wide).otherwise(in_small).cast("int")
