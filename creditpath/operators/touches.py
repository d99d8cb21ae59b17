"""Multi-touch attribution by rule: equal credit for all touches, and credit that halves with age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditpath.functions import ratio
from creditpath.operators.journeys import ORDER
from creditpath.plans.skew import scan_key

HALF_LIFE_SECONDS = 7 * 24 * 3600.0
LINEAR, TIME_DECAY = "linear", "time_decay"


def touch_weights(
    events: DataFrame,
    key: Sequence[str] = ("uid",),
    order: Sequence[str] = ORDER,
    half_life: float = HALF_LIFE_SECONDS,
) -> DataFrame:
    """Per converting journey and channel the credit of its touches, 1 in sum over a journey: ``linear``, ``time_decay``.

    A touch ``t`` seconds before the journey's last event weighs ``2 ** (-t / half_life)``. Exponents
    count from the end, so the last touch weighs 1 and old ones fade to 0; no sum over- or underflows.
    A journey cut into slices has its weights added up against each slice's own end first; the slices'
    few rows are then moved to the journey's end. An event without a time has no time-decay credit.
    """
    time = order[0]
    part = scan_key(events, key)
    moment = F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)
    rows = events.withColumn("_moment", moment)
    rows = rows.withColumn("_end", F.max("_moment").over(Window.partitionBy(*part)))
    fading = F.pow(F.lit(2.0), (F.col("_moment") - F.col("_end")) / F.lit(float(half_life)))
    at = F.struct(*order)
    sums = rows.groupBy(*part, "channel").agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.sum(fading), F.lit(0.0)).alias("_faded"),
        F.max("_end").alias("_end"),
        F.max(at).alias("_last"),
        F.max_by("conversion", at).alias("_converted"),
    )
    journey = Window.partitionBy(*key)
    behind = F.coalesce(F.col("_end") - F.max("_end").over(journey), F.lit(0.0))
    sums = sums.withColumns(
        {
            "_faded": F.col("_faded") * F.pow(F.lit(2.0), behind / F.lit(float(half_life))),
            "_won": F.max_by("_converted", "_last").over(journey) == 1,
        }
    )
    credit = {
        LINEAR: F.col("_n") / F.sum("_n").over(journey),
        TIME_DECAY: ratio(F.col("_faded"), F.sum("_faded").over(journey)),
    }
    credited = sums.withColumns(credit).where("_won")
    return credited.groupBy(*key, "channel").agg(*[F.sum(name).alias(name) for name in credit])


def multi_touch(
    events: DataFrame,
    key: Sequence[str] = ("uid",),
    order: Sequence[str] = ORDER,
    half_life: float = HALF_LIFE_SECONDS,
) -> DataFrame:
    """Conversions credited to each channel and their share of all, for the linear and the time-decay model."""
    weights = touch_weights(events, key, order, half_life)
    sums = weights.groupBy("channel").agg(F.sum(LINEAR).alias(LINEAR), F.sum(TIME_DECAY).alias(TIME_DECAY))
    models = F.array(*[F.struct(F.lit(m).alias("attribution_model"), F.col(m).alias("conversions")) for m in (LINEAR, TIME_DECAY)])
    rows = sums.select("channel", F.explode(models).alias("m")).select("m.attribution_model", "channel", "m.conversions")
    total = F.sum("conversions").over(Window.partitionBy("attribution_model"))
    return rows.withColumn("share", ratio(F.col("conversions"), total))
