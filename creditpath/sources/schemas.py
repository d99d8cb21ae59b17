"""Schemas of the tables that enter or leave the library."""

from pyspark.sql import types as T

# Columns of the raw log as they stand in the files: every field is text.
RAW_LOG = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("uid", "time", "interaction", "channel", "conversion")]
)

# The events table; giving its columns saves the job that would look them up.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

BRONZE = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("interaction", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("conversion", T.IntegerType()),
    ]
)

AD_SPEND = T.StructType(
    [
        T.StructField("campaign_id", T.StringType()),
        T.StructField("total_spend_in_dollars", T.DoubleType()),
        T.StructField("channel_spend", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("campaign_start_date", T.TimestampNTZType()),
    ]
)

ATTRIBUTION = T.StructType(
    [
        T.StructField("attribution_model", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("attribution_percent", T.DoubleType()),
    ]
)
