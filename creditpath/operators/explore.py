"""Counts and contributions that describe an event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditpath.functions import ratio


def row_count(rows: DataFrame):
    """The number of rows as a scalar subquery."""
    return rows.agg(F.count(F.lit(1))).scalar()


def interaction_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("interaction").agg(F.count(F.lit(1)).alias("count"))


def share_by(events: DataFrame, key: Sequence[str], share: str) -> DataFrame:
    """Rows per key, all rows, and their ratio."""
    per_key = events.groupBy(*key).agg(F.count(F.lit(1)).alias("count"))
    total = row_count(events)
    return per_key.withColumn("total_cnt", total).withColumn(share, ratio(F.col("count"), F.col("total_cnt")))


def channel_share(events: DataFrame) -> DataFrame:
    return share_by(events, ["channel"], "p_channel")


def user_activity(events: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Events and share of all events by user."""
    return share_by(events, key, "p_user")


def distinct_users(events: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """One row with the number of users."""
    return events.groupBy(*key).agg(F.lit(1).alias("seen")).agg(F.count(F.lit(1)).alias("n_users"))


def journey_lengths(events: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """The distinct journey lengths and how many users have each."""
    per_user = events.groupBy(*key).agg(F.count(F.lit(1)).alias("count"))
    return per_user.groupBy("count").agg(F.count(F.lit(1)).alias("n_users"))


def clicks_by_rank_stars(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("ctr_rank", "product_stars").agg(F.sum("click").alias("sum_click"))


def contribution(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums of ``columns`` by key with marketing cost, contribution and return on ad spend.

    ``columns`` end with cost per impression, cost per click and revenue, in
    that order. Cost per click counts on every row, not only on clicks.
    """
    *_, cpi, cpc, gpt = [f"sum_{c}" for c in columns]
    sums = rows.groupBy(*key).agg(*[F.sum(c).alias(f"sum_{c}") for c in columns])
    return sums.withColumn("marketing_cost", F.col(cpi) + F.col(cpc)).withColumns(
        {
            "marketing_contribution": F.col(gpt) - F.col("marketing_cost"),
            "ROAS": ratio(F.col(gpt), F.col("marketing_cost")),
        }
    )


def channel_contribution(costed: DataFrame) -> DataFrame:
    return contribution(costed, ["channel"], ["impression", "click", "conversion", "cpi", "cpc", "gpt"])


def ranked_by_return(summary: DataFrame, name: str) -> DataFrame:
    """Add the dense rank by return on ad spend, best first. For summaries of few rows."""
    return summary.withColumn(name, F.dense_rank().over(Window.orderBy(F.col("ROAS").desc_nulls_last())))
