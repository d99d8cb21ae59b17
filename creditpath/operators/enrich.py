"""Rates, click preferences, clicks, cost and the train/validation split of events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditpath import fixed_values as fv
from creditpath.functions import ctr_of_rank, hash01, like_of_stars, lookup

# Rates up to this many entries are compared in place; larger ones are joined.
LITERAL_RATES = 64


def rate_lookup(rows: DataFrame, key: str, rates: Mapping | DataFrame, out: str) -> DataFrame:
    """Attach the rate of ``key`` as ``out``, NULL where the table has none.

    A short mapping becomes a literal. A DataFrame with columns (key, out) is
    joined; Spark broadcasts it when it is small enough.
    """
    if isinstance(rates, Mapping) and len(rates) <= LITERAL_RATES:
        return rows.withColumn(out, lookup(F.col(key), rates))
    if isinstance(rates, Mapping):
        kind = dict(rows.dtypes)[key]
        rates = rows.sparkSession.createDataFrame(list(rates.items()), f"{key} {kind}, {out} double")
    return rows.join(rates.select(key, out), key, "left")


def with_preferences(rows: DataFrame, uid: str = "uid", salt: str = "ctr") -> DataFrame:
    """Click rank of the user and click rate for the product, computed from the row itself."""
    rank = F.floor(hash01(F.col(uid), salt) * fv.CTR_RANKS).cast("int")
    return rows.withColumn("ctr_rank", rank).withColumns(
        {"ctr_perc": ctr_of_rank(F.col("ctr_rank")), "like_perc": like_of_stars(F.col("product_stars"))}
    ).withColumn("ctr", F.col("ctr_perc") * fv.CTR_LIFT * F.col("like_perc"))


def user_preferences(users: DataFrame, salt: str = "ctr") -> DataFrame:
    """One row per user and product stars. ``users`` has one row per ``uid``."""
    stars = F.sequence(F.lit(1), F.lit(fv.STARS))
    each = users.select("uid", F.explode(stars).alias("product_stars"))
    return with_preferences(each, "uid", salt)


def bernoulli_click(events: DataFrame, preferences: DataFrame | None = None, draw: str = "event_id") -> DataFrame:
    """Mark a click with probability ``1.3 * ctr``; a conversion is always a click.

    Without ``preferences`` they are computed in place, which needs no join.
    A given table is joined by user and stars.
    """
    rows = events.drop("click")
    if preferences is None:
        rows = with_preferences(rows)
    else:
        rows = rows.join(preferences, ["uid", "product_stars"], "left")
    drawn = F.when(hash01(F.col(draw), "click") < F.col("ctr") * fv.CTR_LIFT, 1).otherwise(0)
    return rows.withColumn("click", F.when(F.col("conversion") == 1, 1).otherwise(drawn))


def cost_enrich(events: DataFrame) -> DataFrame:
    """Impression flag, cost per thousand, per impression and per click, and revenue of a conversion."""
    rows = rate_lookup(events, "channel", fv.CPM, "cpm")
    rows = rate_lookup(rows, "channel", fv.CPC, "cpc")
    order_value = lookup(F.col("product_stars"), fv.ORDER_VALUE)
    return rows.withColumns(
        {
            "impression": F.when(F.col("interaction") == "impression", 1).otherwise(0),
            "cpi": F.col("cpm") / 1000,
            "gpt": F.when(F.col("conversion") == 1, order_value).otherwise(0.0),
        }
    )


def hash_split(rows: DataFrame, key: str, fractions: Mapping[str, float], salt: str = "split") -> dict[str, DataFrame]:
    """Named parts of ``rows``, each about as large as its fraction.

    A key always falls in the same part, whatever the partitioning of the rows; NULL keys fall in the first.
    """
    total, low, parts = sum(fractions.values()), 0.0, {}
    draw = F.coalesce(hash01(F.col(key), salt), F.lit(0.0))
    for name, fraction in fractions.items():
        high = low + fraction / total
        parts[name] = rows.where((draw >= low) & (draw < high))
        low = high
    return parts
