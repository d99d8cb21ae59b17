"""Conversions per hour and channel from a stream of events that may arrive late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditpath.sources.raw_log import typed
from creditpath.streaming.ingest import stream_raw

HOUR = "1 hour"
DELAY = "6 hours"


def conversions_per_window(events: DataFrame, delay: str = DELAY, length: str = HOUR) -> DataFrame:
    """Events and conversions by window of ``length`` and channel; batch or streaming.

    On a stream, a window is complete, and is returned once, when an event later than its end by
    ``delay`` has been seen; an event that arrives after that is left out. State holds one row per
    open window and channel, whatever the number of events. In a batch every window is complete.
    Events without a time are in no window.
    """
    rows = events.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay)
    counts = rows.groupBy(F.window("time", length), "channel").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("conversion") == 1).alias("n_conversions")
    )
    bounds = [F.col(f"window.{end}").cast("timestamp_ntz").alias(f"window_{end}") for end in ("start", "end")]
    return counts.select(*bounds, "channel", "n_events", "n_conversions")


def stream_conversions(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    delay: str = DELAY,
    length: str = HOUR,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Take in the files that arrived since the last call and append the windows that they complete to the sink.

    Open windows and the watermark are kept in the checkpoint, which must be in a shared folder.
    """
    events = typed(stream_raw(spark, source_dir, max_files_per_trigger))
    query = (
        conversions_per_window(events, delay, length)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start(sink_dir)
    )
    query.awaitTermination()
    return spark.read.parquet(sink_dir)
