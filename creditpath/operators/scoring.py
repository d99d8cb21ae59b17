"""Bid units: predicted values, risk-seeker score and expected results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditpath import fixed_values as fv
from creditpath.functions import ratio
from creditpath.plans.ranges import ntile

BID_UNIT = ["month", "weekofyear", "user_rank", "channel", "product_stars"]
ROW_KEY = ("uid", "time", "channel", "product_stars")

# Visit columns and the names they have as predictions.
PREDICTED = {
    "visit_impr": "impr_pred",
    "visit_clicks": "clicks_pred",
    "visit_txns": "txns_pred",
    "avg_cpi": "cpi_pred",
    "bid_cpc": "cpc_pred",
    "gpt": "gpt_pred",
}


def score_bid_units(silver: DataFrame, predictions: str | None = None, rank_on: str = "row") -> DataFrame:
    """Bid units with sums of impressions, clicks and transactions and mean cost, revenue and rates.

    Observed values stand in for predictions, unless ``predictions`` names a
    column of predicted impressions. ``user_rank`` is the tenth by segment, of
    the rows (``rank_on="row"``) or of the segments (``"segment"``, which
    matches the rank of :func:`risk_seeker_score`).
    """
    rows = silver
    if predictions:
        rows = rows.drop("visit_impr").withColumnRenamed(predictions, "visit_impr")
    rows = rows.select("month", "weekofyear", "VISIT_RANK2", *ROW_KEY, *PREDICTED).withColumnsRenamed(PREDICTED)
    if rank_on == "segment":
        segments = rows.select("VISIT_RANK2").distinct()
        tiles = segment_tiles(segments).withColumnRenamed("VISIT_RANK2", "_segment")
        # A visit without a segment is in the tenth of NULL, not dropped.
        rows = rows.join(F.broadcast(tiles), F.col("VISIT_RANK2").eqNullSafe(F.col("_segment"))).drop("_segment")
    else:
        order = {"segment": F.col("VISIT_RANK2")} | {name: F.col(name) for name in ROW_KEY}
        rows = ntile(rows, fv.RANK_TILES, order, "user_rank")
    rows = rows.withColumns(
        {
            "ctr_pred": F.when(F.col("impr_pred") > 0, F.col("clicks_pred") / F.col("impr_pred")).otherwise(0.0),
            "cvr_pred": F.when(F.col("clicks_pred") > 0, F.col("txns_pred") / F.col("clicks_pred")).otherwise(0.0),
        }
    )
    sums = ["impr_pred", "clicks_pred", "txns_pred"]
    means = ["cpi_pred", "cpc_pred", "gpt_pred", "ctr_pred", "cvr_pred"]
    return rows.groupBy(*BID_UNIT).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means]
    )


def segment_tiles(segments: DataFrame) -> DataFrame:
    """Tenths of the segments; there are at most as many segments as visit ranks."""
    return segments.withColumn("user_rank", F.ntile(fv.RANK_TILES).over(Window.orderBy("VISIT_RANK2")))


def visit_scores(browse: DataFrame, ranks: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Browse probability summed by segment, and relative to the mean segment."""
    users = browse.join(ranks.select(*key, "VISIT_RANK2"), list(key), "left")
    segments = users.groupBy("VISIT_RANK2").agg(F.sum("prob_to_browse").alias("logit_to_visit"))
    mean = F.avg("logit_to_visit").over(Window.partitionBy(F.lit(1)))
    return segments.withColumn("prob_visit_score", ratio(F.col("logit_to_visit"), mean))


def risk_seeker_score(risk_aversion: DataFrame, scores: DataFrame) -> DataFrame:
    """Risk-seeker score and spread of transitions by tenth of the segments."""
    segments = risk_aversion.select("VISIT_RANK2", "transitions", "max_risk_score")
    segments = segments.join(scores.select("VISIT_RANK2", "prob_visit_score"), "VISIT_RANK2", "left")
    segments = segments.withColumn("risk_seeker_score", F.col("max_risk_score") * F.col("prob_visit_score"))
    return segment_tiles(segments).groupBy("user_rank").agg(
        F.avg("transitions").alias("avg_transitions"),
        F.stddev_samp("transitions").alias("std_transitions"),
        F.max("risk_seeker_score").alias("max_risk_seeker_sore"),
        F.avg("risk_seeker_score").alias("avg_risk_seeker_score"),
    )


def with_risk(bid_units: DataFrame, seeker: DataFrame) -> DataFrame:
    """Bid units beside the scores of their user rank, of which there are ten."""
    return bid_units.join(F.broadcast(seeker), "user_rank", "left")


def expected_kpis(bid_units: DataFrame) -> DataFrame:
    """Expected clicks, transactions, revenue and spend of each bid unit."""
    rows = bid_units.withColumn("exp_clicks", F.col("impr_pred") * F.col("ctr_pred"))
    rows = rows.withColumn("exp_txns", F.col("exp_clicks") * F.col("cvr_pred"))
    return rows.withColumns(
        {
            "revenue": F.col("exp_txns") * F.col("gpt_pred"),
            "spend": F.col("impr_pred") * F.col("cpi_pred") + F.col("exp_clicks") * F.col("cpc_pred"),
        }
    )


def scale_constants(kpis: DataFrame) -> DataFrame:
    """One row: revenue per impression (c1), per click (c2) and per transaction (c3)."""
    revenue = F.sum("revenue")
    return kpis.agg(
        ratio(revenue, F.sum("impr_pred").cast("double")).alias("c1"),
        ratio(revenue, F.sum("exp_clicks")).alias("c2"),
        ratio(revenue, F.sum("exp_txns")).alias("c3"),
    )
