"""The ``events`` table seen as a log of ad impressions and conversions."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditpath import fixed_values as fv
from creditpath.plans.skew import HOT_ROWS, SLICE, hot_key_cuts, running_sum_before, with_slices
from creditpath.sources.schemas import EVENTS

# A journey is one user on one day, cut after each conversion. Keeping the three
# parts as the key lets every window and aggregate reuse one shuffle on (user, day).
JOURNEY = ("user_id", "day", "leg")
DAY = ("user_id", "day")
ORDER = ("time", "event_id")


def channel_of(draw: Column) -> Column:
    """The channel for a number in 0..99, by the share of touches each channel has."""
    *names, last = fv.TOUCH_WEIGHTS
    uppers = accumulate(fv.TOUCH_WEIGHTS[name] for name in names)
    branches = [F.when(draw < upper, F.lit(name)) for name, upper in zip(names, uppers)]
    return F.coalesce(*branches, F.lit(last))


def with_channel(rows: DataFrame, props: str = "props") -> DataFrame:
    """Replace the properties by the channel their number stands for."""
    # The number is a column of its own, so that the pattern is matched once per row.
    drawn = rows.withColumn(props, F.regexp_extract(props, "([0-9]+)", 1).cast("int"))
    return drawn.withColumn("channel", channel_of(F.col(props))).drop(props)


def uid() -> Column:
    """The journey id as one string."""
    return F.concat_ws("-", *JOURNEY)


def read_events(spark: SparkSession, data_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{data_dir}/events.parquet")


def ad_events(raw: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ad events with journey key, channel, conversion, click and product stars.

    Columns: user_id, day, leg, uid, event_id, time, interaction, channel,
    conversion, click, product_stars; also ``slice`` when a journey is so long
    that its rows must be spread over several tasks.
    """
    rows = with_channel(raw.select("user_id", "event_id", "ts", "event_type", "props")).select(
        "user_id",
        F.to_date("ts").alias("day"),
        "event_id",
        F.col("ts").alias("time"),
        "channel",
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("conversion"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("click"),
        (1 + F.col("event_id") % fv.STARS).cast("int").alias("product_stars"),
    )
    total = raw.count()
    cuts = hot_key_cuts(rows, DAY, ORDER, hot_rows, total=total)
    rows = with_slices(rows, DAY, ORDER, cuts)
    rows = running_sum_before(rows, DAY, ORDER, "conversion", "leg")
    rows = rows.withColumn("leg", F.col("leg").cast("int"))
    if cuts is not None:
        # Only a hot day can hold a hot journey.
        hot_days = rows.where(F.col(SLICE).isNotNull())
        cuts = hot_key_cuts(hot_days, JOURNEY, ORDER, hot_rows, total=total)
        rows = with_slices(rows.drop(SLICE), JOURNEY, ORDER, cuts)
    events = rows.select(
        "user_id",
        "day",
        "leg",
        "event_id",
        "time",
        F.when(F.col("conversion") == 1, "conversion").otherwise("impression").alias("interaction"),
        "channel",
        "conversion",
        "click",
        "product_stars",
        *[name for name in rows.columns if name == SLICE],
    )
    return events.withColumn("uid", uid())
