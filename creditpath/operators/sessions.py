"""Journeys that end after a pause: a user's events without a longer gap between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditpath.operators.journeys import ORDER, user_journey
from creditpath.plans.skew import (
    HOT_ROWS,
    SLICE,
    hot_key_cuts,
    is_sliced,
    join_slices,
    running_sum_before,
    scan_key,
    slice_totals,
    slice_window,
    split_hot_keys,
    with_slices,
)

GAP_SECONDS = 30 * 60
USER = ("user_id",)
SESSION = ("user_id", "session")


def with_sessions(
    events: DataFrame,
    gap: float = GAP_SECONDS,
    user: Sequence[str] = USER,
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``session``: how many pauses of more than ``gap`` seconds a user made before the event.

    One shuffle by user. A user with more than ``hot_rows`` events is cut into slices: the first event
    of a slice is compared with the last of the slice before, and the pauses before a slice are added
    to its numbers, so a session that goes on over a cut stays one. An event without a time comes
    first and ends no session. The result has a ``slice`` column if a single session is hot.
    """
    rows = split_hot_keys(events.drop(SLICE), user, order, hot_rows)
    time = order[0]
    window = Window.partitionBy(*scan_key(rows, user)).orderBy(*order)
    before = F.max(time).over(window.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", before)
    if is_sliced(rows):
        lasts = slice_totals(rows, user, _last=F.max(time))
        earlier = slice_window(user).rowsBetween(Window.unboundedPreceding, -1)
        lasts = lasts.select(*user, SLICE, F.max("_last").over(earlier).alias("_earlier"))
        rows = join_slices(rows, user, lasts).withColumn("_before", F.coalesce("_before", "_earlier")).drop("_earlier")
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))) / F.lit(1e6)
    rows = rows.withColumn("_pause", F.when(seconds > gap, 1).otherwise(0)).drop("_before")
    rows = running_sum_before(rows, user, order, "_pause", "_pauses")
    session = (F.col("_pauses") + F.col("_pause")).cast("long")
    rows = rows.withColumn("session", session).drop("_pause", "_pauses")
    if not is_sliced(rows):
        return rows
    # Only a hot user can have a hot session.
    key = [*user, "session"]
    cuts = hot_key_cuts(rows.where(F.col(SLICE).isNotNull()), key, order, hot_rows)
    return with_slices(rows.drop(SLICE), key, order, cuts)


def session_journeys(
    events: DataFrame, gap: float = GAP_SECONDS, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The journey of each session, as :func:`user_journey` gives it."""
    return user_journey(with_sessions(events, gap, USER, order, hot_rows), SESSION, order)
