"""Per-user transitions, exposure, browse probability and risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditpath.fixed_values import CONVERSION, NULL, START
from creditpath.functions import ratio
from creditpath.operators.explore import row_count
from creditpath.plans.small import settle


def user_transition_matrix(transitions: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """The transition matrix of each user, with counts. (The odd spelling of the count is the customary name.)"""
    counts = transitions.groupBy(*key, "start_state", "end_state").agg(F.sum("cnt").alias("nstate_trainsitions"))
    from_state = F.sum("nstate_trainsitions").over(Window.partitionBy(*key, "start_state"))
    total = "total_state_transitions_initiated_from_start_state"
    return counts.withColumn(total, from_state).withColumn(
        "transition_probability", ratio(F.col("nstate_trainsitions"), F.col(total))
    )


def user_state_probabilities(matrix: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Adds to each user's matrix the probability of the start state and of the step itself."""
    per_user = F.sum("nstate_trainsitions").over(Window.partitionBy(*key))
    rows = matrix.withColumn("total_transitions_per_user", per_user).withColumns(
        {
            "nstart_states": F.col("total_state_transitions_initiated_from_start_state"),
            "conversion": F.when(F.col("end_state") == CONVERSION, 1).otherwise(0),
        }
    )
    rows = rows.withColumn(
        "start_state_probability", ratio(F.col("nstart_states"), F.col("total_transitions_per_user"))
    )
    end = F.col("start_state_probability") * F.col("transition_probability")
    return rows.withColumn("end_state_probability", end)


def with_total_rows(rows: DataFrame) -> DataFrame:
    """Adds the number of all rows to every row."""
    return rows.withColumn("total_nrows", row_count(rows))


def state_exposure(probabilities: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Conversions and probability to browse on, by user and start state."""
    on = probabilities.where(F.col("end_state") != NULL)
    return on.groupBy(
        *key,
        "start_state",
        "total_state_transitions_initiated_from_start_state",
        "total_transitions_per_user",
        "start_state_probability",
    ).agg(F.sum("conversion").alias("conversions"), F.sum("end_state_probability").alias("to_browse_prob"))


def browse_by_state(exposure: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Transitions and browse probability by user and channel."""
    return exposure.where(F.col("start_state") != START).groupBy(*key, "start_state").agg(
        F.sum("total_state_transitions_initiated_from_start_state").alias("transitions"),
        F.sum("to_browse_prob").alias("to_browse"),
    )


def browse_probability(ends: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """The share of a user's transitions that leave a channel for anything but Null.

    A journey of n events has n + 1 transitions, n of which leave a channel, all
    but a final one to Null. Users without any such step have no row.
    """
    going_on = F.col("n_events") - 1 + F.col("conversion")
    rows = ends.where(going_on > 0)
    return rows.select(*key, ratio(going_on, F.col("n_events") + 1).alias("prob_to_browse"))


def channel_risk_score(probabilities: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Transitions of the user over a threshold of the channel, by user and channel.

    The threshold is mean minus deviation of the transitions per user over the
    matrix rows of the channel, or 0. A risk over 0 is NULL.
    """
    n = "total_transitions_per_user"
    stats = probabilities.where(F.col("start_state") != START).groupBy("start_state").agg(
        F.avg(n).alias("avg_transitions_per_chanel"), F.stddev_samp(n).alias("std_transitions_per_channel")
    )
    gap = F.col("avg_transitions_per_chanel") - F.col("std_transitions_per_channel")
    # One row per channel, computed first: a join by channel would gather the users of each channel in one place.
    stats = settle(stats.withColumn("thresh_per_channel", F.when(gap > 0, gap).otherwise(0.0)))
    states = probabilities.where(F.col("start_state") != START).groupBy(*key, "start_state")
    states = states.agg(F.max(n).alias(n))
    return states.join(stats, "start_state", "left").withColumn("risk_score", ratio(F.col(n), F.col("thresh_per_channel")))


def user_risk(scores: DataFrame, ranks: DataFrame, browse: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Highest risk of each user with segment and browse probability; a user without one gets 1."""
    per_user = scores.groupBy(*key).agg(
        F.max("total_transitions_per_user").alias("max_transitions"), F.max("risk_score").alias("risk_score")
    )
    joined = per_user.join(ranks.select(*key, "VISIT_RANK2"), list(key), "left").join(browse, list(key), "left")
    return joined.fillna(1.0, subset=["prob_to_browse"])


def segment_risk_aversion(risk: DataFrame) -> DataFrame:
    p = F.stddev_samp("prob_to_browse")
    return risk.groupBy("VISIT_RANK2").agg(
        F.sum("max_transitions").alias("transitions"),
        F.avg("risk_score").alias("risk_score"),
        F.max("risk_score").alias("max_risk_score"),
        p.alias("std_prob"),
        (100 * p * p).alias("std_prob2"),
    )


def user_product_funnel(visits: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Impressions, clicks, transactions and rates by user and stars.

    Mean and deviation are over the one total of each user and product, so they
    are the total itself and 0.
    """
    sums = visits.groupBy(*key, "product_stars").agg(
        F.sum("visit_impr").alias("total_impr"), F.sum("visit_clicks").alias("clicks"), F.sum("visit_txns").alias("txns")
    )
    impr, clicks, txns = F.col("total_impr"), F.col("clicks"), F.col("txns")
    per_impr = ratio(txns, impr)
    return sums.withColumns(
        {
            "avg_impr_per_product": impr.cast("double"),
            "std_impr": F.when(impr.isNotNull(), 0.0),
            "CTR": ratio(clicks, impr),
            "CVR": F.when(clicks > 0, ratio(txns, clicks)).otherwise(per_impr),
            "CVR2": F.when(impr > 0, per_impr).otherwise(0.0),
        }
    )


def user_end_states(probabilities: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """Probability, conversions and their product by user and end state."""
    per_state = probabilities.groupBy(*key, "end_state").agg(
        F.sum("end_state_probability").alias("p_end_state"), F.sum("conversion").alias("conversions")
    )
    return per_state.withColumn("p_conversion", F.col("p_end_state") * F.col("conversions"))


def end_state_conversion(per_state: DataFrame) -> DataFrame:
    """Sums, means and deviations over the users by end state."""
    aggregates = []
    for column, name in (("p_end_state", "p_end"), ("p_conversion", "p_conv")):
        aggregates += [
            F.sum(column).alias(f"sum_{name}"),
            F.avg(column).alias(f"avg_{name}"),
            F.stddev_samp(column).alias(f"std_{name}"),
        ]
    return per_state.groupBy("end_state").agg(*aggregates)


def transition_summary(probabilities: DataFrame) -> DataFrame:
    """Totals by step over all users; the means are negated, which sorts the likeliest first."""
    return probabilities.groupBy("start_state", "end_state").agg(
        F.sum("nstate_trainsitions").alias("ntransitions"),
        F.sum("conversion").alias("nconversions"),
        (-F.avg("transition_probability")).alias("avg_transition_prob"),
        (-F.avg("start_state_probability")).alias("avg_start_prob"),
    )


def edges_per_user(matrix: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    return matrix.groupBy(*key).agg(F.count(F.lit(1)).alias("cnt"))


def transitions_per_user(scores: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """The user's transitions counted once for each channel the user met."""
    return scores.groupBy(*key).agg(F.sum("total_transitions_per_user").alias("transitions"))


def converting_edges(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.col("end_state") == CONVERSION)


def user_row_sums(matrix: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """The probabilities leaving each state of each user; every sum must be 1."""
    return matrix.groupBy(*key, "start_state").agg(F.sum("transition_probability").alias("sum_p"))
