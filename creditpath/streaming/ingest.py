"""Incremental ingestion of the raw log into the bronze table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditpath.sources.raw_log import read_raw, typed
from creditpath.sources.schemas import RAW_LOG


def stream_raw(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The CSV files of a folder as a stream, those already there included."""
    reader = spark.readStream.schema(RAW_LOG).option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(source_dir)


def ingest(
    spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Append the files that arrived since the last call to bronze, each exactly once.

    The checkpoint remembers which files were read; calling again after a
    failure continues where the last run stopped.
    """
    bronze = typed(stream_raw(spark, source_dir, max_files_per_trigger))
    query = (
        bronze.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start(sink_dir)
    )
    query.awaitTermination()
    return spark.read.parquet(sink_dir)


def backfill(spark: SparkSession, source_dir: str, sink_dir: str) -> DataFrame:
    """The batch form of :func:`ingest` for a folder that is complete.

    An existing ``sink_dir`` is an error: a rerun would repeat its rows, and a streamed
    sink would hide them.
    """
    typed(read_raw(spark, source_dir)).write.mode("errorifexists").parquet(sink_dir)
    return spark.read.parquet(sink_dir)
