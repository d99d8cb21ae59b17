"""Journeys, single-touch attribution and state transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditpath.fixed_values import CONVERSION, NULL, START
from creditpath.functions import ratio
from creditpath.plans.skew import SLICE, is_sliced, join_slices, scan_key, slice_totals, slice_window

ORDER = ("time", "event_id")
# Events in one row of a journey; a longer journey has several rows.
PART_STEPS = 100_000


def journey_ends(events: DataFrame, key: Sequence[str] = ("uid",), order: Sequence[str] = ORDER) -> DataFrame:
    """First and last channel, conversion of the last event and length of each journey.

    Plain aggregates that combine before the shuffle, so long journeys cost nothing extra.
    """
    at = F.struct(*order)
    return events.groupBy(*key).agg(
        F.min_by("channel", at).alias("first_interaction"),
        F.max_by("channel", at).alias("last_interaction"),
        F.max_by("conversion", at).alias("conversion"),
        F.count(F.lit(1)).alias("n_events"),
    )


def with_visit_order(events: DataFrame, key: Sequence[str] = ("uid",), order: Sequence[str] = ORDER) -> DataFrame:
    """Add ``visit_order``: the dense rank of the event's time within its journey."""
    time = order[0]
    local = F.dense_rank().over(Window.partitionBy(*scan_key(events, key)).orderBy(time))
    rows = events.withColumn("visit_order", local)
    if not is_sliced(events):
        return rows
    slices = slice_window(key)
    times = slice_totals(events, key, _n=F.count_distinct(time), _first=F.min(time), _last=F.max(time))
    # A time that goes on from the slice before has been counted there.
    times = times.withColumn("_again", F.when(F.lag("_last").over(slices) == F.col("_first"), 1).otherwise(0))
    offset = F.sum("_n").over(slices) - F.col("_n") - F.sum("_again").over(slices)
    rows = join_slices(rows, key, times.select(*key, SLICE, offset.alias("_offset")))
    order_in_journey = F.col("visit_order") + F.coalesce("_offset", F.lit(0))
    return rows.withColumn("visit_order", order_in_journey.cast("int")).drop("_offset")


def with_journey_ends(events: DataFrame, key: Sequence[str] = ("uid",), order: Sequence[str] = ORDER) -> DataFrame:
    """Add the event's ``position`` (from 0) and its journey's ``n_events``, first and last channel and outcome.

    The outcome ``converted`` is the ``conversion`` of the last event.
    """
    window = Window.partitionBy(*scan_key(events, key)).orderBy(*order)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = events.withColumns(
        {
            "position": F.row_number().over(window).cast("long") - 1,
            "n_events": F.count(F.lit(1)).over(whole),
            "first_interaction": F.first("channel").over(whole),
            "last_interaction": F.last("channel").over(whole),
            "converted": F.last("conversion").over(whole),
        }
    )
    if not is_sliced(events):
        return rows
    at = F.struct(*order)
    slices = slice_window(key)
    every = slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"first_interaction": F.min_by("channel", at), "last_interaction": F.max_by("channel", at)}
    ends["converted"] = F.max_by("conversion", at)
    found = slice_totals(events, key, _n=F.count(F.lit(1)), **{f"_{name}": end for name, end in ends.items()})
    found = found.select(
        *key,
        SLICE,
        (F.sum("_n").over(slices) - F.col("_n")).alias("_before"),
        F.sum("_n").over(every).alias("_all"),
        F.first("_first_interaction").over(every).alias("_first"),
        F.last("_last_interaction").over(every).alias("_last"),
        F.last("_converted").over(every).alias("_converted"),
    )
    carried = F.col("_all").isNotNull()
    return join_slices(rows, key, found).withColumns(
        {
            "position": F.col("position") + F.coalesce("_before", F.lit(0)),
            "n_events": F.coalesce("_all", "n_events"),
            "first_interaction": F.when(carried, F.col("_first")).otherwise(F.col("first_interaction")),
            "last_interaction": F.when(carried, F.col("_last")).otherwise(F.col("last_interaction")),
            "converted": F.when(carried, F.col("_converted")).otherwise(F.col("converted")),
        }
    ).drop("_before", "_all", "_first", "_last", "_converted")


def user_journey(
    events: DataFrame, key: Sequence[str] = ("uid",), order: Sequence[str] = ORDER, part_steps: int = PART_STEPS
) -> DataFrame:
    """The path ``Start > channel > ... > Conversion`` (or ``Null``) of each journey.

    Every ``part_steps`` events of a journey are one row, numbered by ``part`` from 0: the row's
    place depends on the event's position alone. The ``path`` and ``visiting_order`` of a journey's
    parts, joined in order, are the whole; its other columns are the same in each part.
    """
    steps = with_journey_ends(with_visit_order(events, key, order), key, order)
    steps = steps.withColumn("part", F.floor(F.col("position") / F.lit(part_steps)).cast("int"))
    whole = ["first_interaction", "last_interaction", "converted", "n_events"]
    rows = steps.groupBy(*key, "part").agg(
        F.array_sort(F.collect_list(F.struct("position", "channel", "visit_order"))).alias("steps"),
        *[F.first(name).alias(name) for name in whole],
    )
    outcome = F.when(F.col("converted") == 1, CONVERSION).otherwise(NULL)
    closes = F.col("part") == F.floor((F.col("n_events") - 1) / F.lit(part_steps))
    channels = F.array_join(F.col("steps.channel"), " > ")
    path = F.concat_ws(" > ", F.when(F.col("part") == 0, F.lit(START)), channels, F.when(closes, outcome))
    return rows.select(
        *key,
        "part",
        path.alias("path"),
        "first_interaction",
        "last_interaction",
        F.col("converted").alias("conversion"),
        F.col("steps.visit_order").alias("visiting_order"),
    )


def first_last_touch(ends: DataFrame) -> DataFrame:
    """Share of conversions by first and by last channel, from :func:`journey_ends`.

    ``attribution_percent`` is rounded to cents, ``share`` is not.
    """
    won = ends.where(F.col("conversion") == 1)
    touch = F.explode(
        F.array(
            F.struct(F.lit("first_touch").alias("attribution_model"), F.col("first_interaction").alias("channel")),
            F.struct(F.lit("last_touch").alias("attribution_model"), F.col("last_interaction").alias("channel")),
        )
    )
    counts = won.select(touch.alias("t")).groupBy("t.attribution_model", "t.channel").agg(F.count(F.lit(1)).alias("n"))
    # Every conversion has one row per model, so the total of a model is the number of conversions.
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy("attribution_model")))
    return counts.select("attribution_model", "channel", F.round(share, 2).alias("attribution_percent"), share.alias("share"))


def linked_steps(events: DataFrame, key: Sequence[str] = ("uid",), order: Sequence[str] = ORDER) -> DataFrame:
    """Add the channel before each event (NULL at the start) and whether the event is the last."""
    window = Window.partitionBy(*scan_key(events, key)).orderBy(*order)
    rows = events.withColumns(
        {
            "previous": F.lag("channel").over(window),
            "is_last": F.lead(F.lit(1)).over(window).isNull(),
        }
    )
    if not is_sliced(events):
        return rows
    slices = slice_window(key)
    tails = slice_totals(events, key, _tail=F.max_by("channel", F.struct(*order)))
    tails = tails.select(
        *key, SLICE, F.lag("_tail").over(slices).alias("_before"), F.lead("_tail").over(slices).isNotNull().alias("_more")
    )
    return join_slices(rows, key, tails).withColumns(
        {
            "previous": F.coalesce("previous", "_before"),
            "is_last": F.col("is_last") & ~F.coalesce("_more", F.lit(False)),
        }
    ).drop("_before", "_more")


def transitions(events: DataFrame, key: Sequence[str] = ("uid",), order: Sequence[str] = ORDER) -> DataFrame:
    """One row per step from state to state, ``Start`` and the outcome included."""
    steps = linked_steps(events, key, order)
    outcome = F.when(F.col("conversion") == 1, CONVERSION).otherwise(NULL)
    come = F.struct(F.coalesce("previous", F.lit(START)).alias("start_state"), F.col("channel").alias("end_state"))
    leave = F.struct(F.col("channel").alias("start_state"), outcome.alias("end_state"))
    moves = F.when(F.col("is_last"), F.array(come, leave)).otherwise(F.array(come))
    return steps.select(*key, F.explode(moves).alias("move")).select(*key, "move.*", F.lit(1).alias("cnt"))
