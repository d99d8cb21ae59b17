"""The raw CSV log: reading it, typing it, and counting what could not be typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditpath.sources.schemas import RAW_LOG

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of the CSV files under ``path``; all fields are text."""
    return spark.read.schema(RAW_LOG).option("header", True).csv(path)


def _read_time() -> Column:
    return F.try_to_timestamp("time", F.lit(TIME_FORMAT)).cast("timestamp_ntz")


def _read_conversion() -> Column:
    return F.col("conversion").try_cast("int")


def typed(raw: DataFrame) -> DataFrame:
    """Bronze rows from raw ones, batch or streaming. Unreadable values become NULL."""
    return raw.withColumns({"time": _read_time(), "conversion": _read_conversion()})


def rejected(raw: DataFrame) -> DataFrame:
    """One row: the row count, and how many rows have an unreadable time or conversion."""
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("time").isNotNull() & _read_time().isNull()).alias("bad_time"),
        F.count_if(F.col("conversion").isNotNull() & _read_conversion().isNull()).alias("bad_conversion"),
    )


def write_raw(events: DataFrame, path: str) -> None:
    """Write events as raw CSV files with a header line."""
    text = events.select("uid", F.date_format("time", TIME_FORMAT).alias("time"), "interaction", "channel", "conversion")
    text.write.option("header", True).csv(path)
