"""Campaign spend beside attribution: conversions, cost per acquisition, reallocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditpath import fixed_values as fv
from creditpath.functions import ratio
from creditpath.sources.schemas import AD_SPEND


def campaign(spark: SparkSession, budget: float = fv.CAMPAIGN_BUDGET) -> DataFrame:
    """The campaign whose budget is spread evenly over the channels."""
    shares = dict.fromkeys(fv.TOUCH_WEIGHTS, fv.CAMPAIGN_SHARE)
    row = spark.createDataFrame([(fv.CAMPAIGN_ID, float(budget), shares)], AD_SPEND.fieldNames()[:3])
    return row.withColumn("campaign_start_date", F.lit(fv.CAMPAIGN_START).cast("timestamp_ntz")).to(AD_SPEND)


def spend_table(spend: DataFrame) -> DataFrame:
    """Campaigns from rows (campaign_id, channel, spend, time): totals, and shares as a map."""
    channels = spend.groupBy("campaign_id", "channel").agg(F.sum("spend").alias("spend"), F.min("time").alias("time"))
    campaigns = channels.groupBy("campaign_id").agg(
        F.sum("spend").alias("total_spend_in_dollars"),
        F.map_from_entries(F.collect_list(F.struct("channel", "spend"))).alias("channel_spend"),
        F.min("time").alias("campaign_start_date"),
    )
    share = F.transform_values("channel_spend", lambda _, v: ratio(v, F.col("total_spend_in_dollars")))
    return campaigns.withColumn("channel_spend", share)


def ad_spend_exploded(campaigns: DataFrame) -> DataFrame:
    """One row per campaign and channel: share and dollars."""
    rows = campaigns.select("campaign_id", "total_spend_in_dollars", F.explode("channel_spend").alias("channel", "pct_spend"))
    dollars = F.round(F.col("total_spend_in_dollars") * F.col("pct_spend"), 2)
    return rows.select("campaign_id", "channel", "pct_spend", dollars.alias("dollar_spend"))


def base_conversion_rate(ends: DataFrame) -> DataFrame:
    """Journeys by outcome."""
    counts = ends.groupBy("conversion").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("count", F.when(F.col("conversion") == 0, "Impression").otherwise("Conversion").alias("interaction_type"))


def conversions_by_date(events: DataFrame) -> DataFrame:
    won = events.where(F.col("conversion") == 1).groupBy(F.to_date("time").alias("date"))
    return won.agg(F.count(F.lit(1)).alias("count")).select("count", F.lit("Conversion").alias("interaction_type"), "date")


def attributed_conversions(attribution: DataFrame, ends: DataFrame) -> DataFrame:
    """Whole conversions by model and channel."""
    total = ends.agg(F.count_if(F.col("conversion") == 1)).scalar()
    whole = F.round(F.col("attribution_percent") * total)
    return attribution.select("attribution_model", "channel", whole.alias("conversions_attributed"))


def cost_per_acquisition(spend: DataFrame, attributed: DataFrame) -> DataFrame:
    joined = spend.select("channel", "dollar_spend").join(attributed, "channel")
    cost = F.round(ratio(F.col("dollar_spend"), F.col("conversions_attributed")), 2)
    return joined.withColumn("CPA_in_Dollars", cost)


def budget_reallocation(spend: DataFrame, attribution: DataFrame, model: str = "markov_chain") -> DataFrame:
    """Return of each channel as share of conversions over share of spend, and the budget it argues for."""
    chosen = attribution.where(F.col("attribution_model") == model).select("channel", "attribution_percent")
    rows = spend.select("channel", "pct_spend", "dollar_spend").join(chosen, "channel")
    rows = rows.withColumn("ROAS", ratio(F.col("attribution_percent"), F.col("pct_spend")))
    return rows.withColumn("proposed_dollar_spend", F.round(F.col("ROAS") * F.col("dollar_spend"), 2))


def current_and_proposed(spend: DataFrame, reallocated: DataFrame) -> DataFrame:
    """Both budgets, stacked."""
    current = spend.select("channel", F.lit("current_spending").alias("spending"), F.col("dollar_spend").alias("budget"))
    proposed = reallocated.select(
        "channel", F.lit("proposed_spending").alias("spending"), F.col("proposed_dollar_spend").alias("budget")
    )
    return current.unionByName(proposed).distinct()
