"""Choosing bid units under a target return on ad spend.

Maximise the sum of v * x over 0 <= x <= 1 subject to the sum of
(spend - revenue / target) * x being at most 0. With one constraint this is the
continuous knapsack problem (Dantzig 1957): units that relax the constraint are
taken whole, and the room they make goes to the others by value per weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditpath import fixed_values as fv
from creditpath.operators.scoring import BID_UNIT, scale_constants
from creditpath.plans.ranges import share_within
from creditpath.plans.small import settle


class NegativeValueError(ValueError):
    """A bid unit has a negative objective value, for which taking units greedily is not optimal."""


def revenue_value() -> Column:
    return F.col("revenue")


def risk_adjusted_value(kpis: DataFrame) -> Column:
    """Revenue plus risk score times revenue per impression times spread of transitions."""
    c1 = scale_constants(kpis).select("c1").scalar()
    risk = F.coalesce("avg_risk_seeker_score", F.lit(0.0)) * c1 * F.coalesce("std_transitions", F.lit(0.0))
    return F.col("revenue") + risk


def allocate(
    kpis: DataFrame, value: Column, target: float = fv.TARGET_ROAS, key: Sequence[str] = tuple(BID_UNIT)
) -> DataFrame:
    """Add value ``v``, weight ``w``, share ``x`` in 0..1 and ``opt_result`` (1 from one half up).

    Units of equal value per weight are taken in the order of ``key``, which must be unique.
    A unit without a known weight or value cannot be ranked: it is kept with ``x`` 0.
    """
    units = settle(kpis.withColumns({"v": value, "w": F.col("spend") - F.col("revenue") / F.lit(target)}))
    found = units.agg(
        F.count(F.lit(1)).alias("total"),
        F.min("v").alias("least"),
        F.sum(F.when(F.col("v").isNotNull(), F.greatest(-F.col("w"), F.lit(0.0)))).alias("room"),
    ).first()
    if found["least"] is not None and found["least"] < 0:
        raise NegativeValueError("the objective needs values of at least 0")
    ranked = units.where("v IS NOT NULL AND w IS NOT NULL")
    unknown = units.where("v IS NULL OR w IS NULL").withColumn("x", F.lit(0.0))
    free = ranked.where("w <= 0").withColumn("x", F.lit(1.0))
    order = {"density": -F.col("v") / F.col("w")} | {name: F.col(name) for name in key}
    paid = share_within(ranked.where("w > 0"), found["total"], order, "w", F.lit(found["room"]), "x")
    chosen = free.unionByName(paid).unionByName(unknown)
    return chosen.withColumn("opt_result", F.when(F.col("x") >= 0.5, 1).otherwise(0))


def allocation_summary(chosen: DataFrame) -> DataFrame:
    """Predictions by channel and choice."""
    sums = {"impr_pred": "impr", "clicks_pred": "clicks", "txns_pred": "txns"}
    means = {"cpi_pred": "cpm", "cpc_pred": "cpc", "gpt_pred": "gpt", "ctr_pred": "ctr", "cvr_pred": "cvr"}
    return chosen.groupBy("channel", "opt_result").agg(
        *[F.sum(c).alias(name) for c, name in sums.items()], *[F.avg(c).alias(name) for c, name in means.items()]
    )
