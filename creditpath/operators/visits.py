"""Visit profiles, contributions, rankings and summaries of users, products and channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditpath import fixed_values as fv
from creditpath.functions import calendar_features, exact_mean, exact_sum
from creditpath.operators.explore import contribution
from creditpath.plans.ranges import ntile
from creditpath.plans.skew import is_sliced

BID_COLUMNS = ["visit_impr", "visit_clicks", "visit_txns", "avg_cpi", "bid_cpc", "gpt"]


def _product_aggregates() -> dict:
    return {
        "visit_clicks": F.sum("click"),
        "visit_txns": F.sum("conversion"),
        "max_cpm": F.max("cpm"),
        "avg_cpi": F.avg("cpi"),
        "bid_cpc": F.max("cpc"),
        "gpt": F.avg("gpt"),
    }


def _with_uid(key: Sequence[str]) -> list[str]:
    """The key and ``uid``, which orders users that are equal otherwise."""
    return [*key] if "uid" in key else [*key, "uid"]


def visit_profile(costed: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """The distinct visits (user, time, channel, stars), each with the totals of its
    user and channel, and of its user, channel and stars.

    Windows share one shuffle with the distinct. When the events are sliced
    because a journey is too long for one task, the totals are aggregated and
    joined back instead, which spreads the journey over all tasks.
    """
    columns = [*key, "time", "channel", "product_stars"]
    if not is_sliced(costed):
        by_channel = Window.partitionBy(*key, "channel")
        by_product = Window.partitionBy(*key, "channel", "product_stars")
        totals = {"visit_impr": F.count("interaction").over(by_channel)}
        totals |= {name: total.over(by_product) for name, total in _product_aggregates().items()}
        return costed.select(*columns, *[total.alias(name) for name, total in totals.items()]).distinct()
    products = costed.groupBy(*key, "channel", "product_stars").agg(
        *[total.alias(name) for name, total in _product_aggregates().items()],
        F.count("interaction").alias("_n"),
    )
    # At most one row per product in this window: the long journeys are aggregated by now.
    impressions = F.sum("_n").over(Window.partitionBy(*key, "channel"))
    products = products.withColumn("visit_impr", impressions).drop("_n")
    visits = costed.select(*columns).distinct().join(products, [*key, "channel", "product_stars"])
    return visits.select(*columns, "visit_impr", *_product_aggregates())


def with_calendar(visits: DataFrame) -> DataFrame:
    return visits.withColumns(calendar_features(F.col("time")))


def customer_contribution(visits: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    return contribution(visits, key, BID_COLUMNS)


def visit_rank(contributions: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Per user: ``VISIT_RANK`` in hundredths by total impressions, ties by ``uid``, and
    ``VISIT_RANK2``, the dense rank of the hundredths by their impressions.
    """
    users = contributions.select(*_with_uid(key), "sum_visit_impr")
    order = {"impressions": F.col("sum_visit_impr"), "uid": F.col("uid")}
    ranked = ntile(users, fv.VISIT_TILES, order, "VISIT_RANK")
    tiles = ranked.groupBy("VISIT_RANK").agg(F.sum("sum_visit_impr").alias("visits"))
    # One row per hundredth.
    tiles = tiles.select("VISIT_RANK", F.dense_rank().over(Window.orderBy("visits")).alias("VISIT_RANK2"))
    return ranked.join(F.broadcast(tiles), "VISIT_RANK", "left").select(
        *_with_uid(key), "sum_visit_impr", "VISIT_RANK", "VISIT_RANK2"
    )


def rank_extremes(ranks: DataFrame) -> DataFrame:
    """Smallest and largest impressions and ranks, in one pass."""
    columns = ["sum_visit_impr", "VISIT_RANK", "VISIT_RANK2"]
    return ranks.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def tile_sums(ranked: DataFrame, tile: str, value: str, name: str) -> DataFrame:
    """Total, smallest and largest ``value`` of each tile."""
    return ranked.groupBy(tile).agg(
        F.sum(value).alias(name), F.min(value).alias(f"min_{value}"), F.max(value).alias(f"max_{value}")
    )


def click_deciles(contributions: DataFrame) -> DataFrame:
    """Clicks of each tenth of the users, most clicks first."""
    users = contributions.select("uid", "sum_visit_clicks")
    order = {"clicks": -F.col("sum_visit_clicks"), "uid": F.col("uid")}
    ranked = ntile(users, fv.RANK_TILES, order, "CLICKS_RANK")
    return ranked.groupBy("CLICKS_RANK").agg(F.sum("sum_visit_clicks").alias("sum_visit_clicks"))


def impression_percentiles(totals: DataFrame) -> DataFrame:
    """Impressions of each hundredth of the users, fewest first, from :func:`user_totals`."""
    users = totals.select("uid", "user_impr")
    order = {"impressions": F.col("user_impr"), "uid": F.col("uid")}
    return tile_sums(ntile(users, fv.VISIT_TILES, order, "VISIT_RANK3"), "VISIT_RANK3", "user_impr", "sum_user_impr")


def channel_clicks_and_customers(channels: DataFrame, events: DataFrame) -> DataFrame:
    """Clicks by channel beside the event count, which keeps the customary name ``ncust``."""
    counts = events.groupBy("channel").agg(F.count(F.lit(1)).alias("ncust"))
    return channels.select("channel", "sum_visit_clicks").join(counts, "channel")


def silver_visits(visits: DataFrame, ranks: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Visits with calendar columns and the rank of their user."""
    return with_calendar(visits).join(ranks.select(*key, "sum_visit_impr", "VISIT_RANK2"), list(key), "left")


def user_totals(costed: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Totals, mean rates and mean order value of each user; exact sums, divided once."""
    return costed.groupBy(*key).agg(
        F.count("interaction").alias("user_impr"),
        F.sum("click").alias("user_clicks"),
        F.sum("conversion").alias("user_txns"),
        exact_mean("cpi").alias("user_cpi"),
        F.max("cpc").alias("user_cpc"),
        exact_mean("gpt").alias("user_gpt"),
    )


def segment_revenue(totals: DataFrame, ranks: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Revenue by user segment. ``cpm`` is the mean cost per impression, as it is customarily named.

    Users' means are added up as decimals, so the order of additions does not show.
    """
    users = totals.join(ranks.select(*key, "VISIT_RANK2"), list(key), "left")
    return users.groupBy("VISIT_RANK2").agg(
        F.sum("user_impr").alias("impr"),
        F.sum("user_clicks").alias("clicks"),
        F.sum("user_txns").alias("txns"),
        exact_mean("user_cpi").alias("cpm"),
        exact_mean("user_cpc").alias("cpc"),
        exact_sum("user_gpt").alias("potential_gp"),
        exact_mean("user_gpt").alias("avg_gpt"),
        F.stddev_samp("user_gpt").alias("std_gpt"),
    )


def silver_summary(silver: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Visits by user, channel, stars and calendar day. ``total_impr`` adds the user's total once per visit."""
    return silver.groupBy("month", "weekofyear", "dayofweek", *key, "channel", "product_stars").agg(
        F.sum("visit_impr").alias("impr"),
        F.sum("sum_visit_impr").alias("total_impr"),
        F.sum("visit_clicks").alias("clicks"),
        F.sum("visit_txns").alias("txns"),
        F.max("max_cpm").alias("cpm"),
        F.avg("bid_cpc").alias("cpc"),
        F.avg("gpt").alias("gpt"),
    )


def daily_user_rollup(summary: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """The summary by user and calendar day; "first" is the first by channel and stars."""
    first = F.struct("channel", "product_stars")
    return summary.groupBy("month", "weekofyear", "dayofweek", *key).agg(
        F.min_by("channel", first).alias("channel"),
        F.avg("product_stars").alias("avg_product_stars"),
        F.sum("impr").alias("sum_impr"),
        F.min_by("total_impr", first).alias("first_total_impr"),
        F.sum("clicks").alias("sum_clicks"),
        F.sum("txns").alias("sum_txns"),
        F.avg("cpm").alias("avg_cpm"),
        F.avg("cpc").alias("avg_cpc"),
        F.avg("gpt").alias("avg_gpt"),
    )


def clicks_over_impressions(summary: DataFrame) -> DataFrame:
    """Rows that have more clicks than impressions."""
    return summary.where(F.col("clicks") > F.col("impr"))


def quality_checks(silver: DataFrame, summary: DataFrame) -> DataFrame:
    """Row counts before and after the summary, and of the rows that look wrong."""
    before = silver.agg(F.lit("silver_rows").alias("check_name"), F.count(F.lit(1)).alias("n_rows"))
    after = summary.agg(
        F.count(F.lit(1)).alias("summary_rows"), F.count_if(F.col("clicks") > F.col("impr")).alias("clicks_over_impr")
    ).unpivot([], ["summary_rows", "clicks_over_impr"], "check_name", "n_rows")
    return before.unionByName(after)
