"""Shapley attribution: a channel's mean gain over all orders in which channels could be added."""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditpath.functions import lookup, ratio
from creditpath.operators.journeys import ORDER

# Channels whose subsets are enumerated: 2^16 of them are 65,536 rows.
MAX_CHANNELS = 16
CONVERSIONS, RATE = "conversions", "rate"


class TooManyChannelsError(ValueError):
    """More channels than subsets can be enumerated for."""


def known_channels(events: DataFrame, max_channels: int = MAX_CHANNELS) -> list[str]:
    """The channels of the events in order, at most ``max_channels``."""
    found = events.where("channel IS NOT NULL").select("channel").distinct().limit(max_channels + 1).collect()
    if len(found) > max_channels:
        raise TooManyChannelsError(f"more than {max_channels} channels: their subsets are too many to enumerate")
    return sorted(row["channel"] for row in found)


def channel_sets(
    events: DataFrame, channels: Sequence[str], key: Sequence[str] = ("uid",), order: Sequence[str] = ORDER
) -> DataFrame:
    """``mask`` (bit i: the i-th channel), the journeys that touch just these channels, and how many converted.

    Aggregates combine before each shuffle; the result has at most one row per subset.
    """
    bit = lookup(F.col("channel"), {name: 1 << i for i, name in enumerate(channels)})
    journeys = events.groupBy(*key).agg(
        F.coalesce(F.bit_or(bit.cast("int")), F.lit(0)).alias("mask"),
        F.max_by("conversion", F.struct(*order)).alias("won"),
    )
    return journeys.groupBy("mask").agg(
        F.count(F.lit(1)).alias("journeys"), F.sum((F.col("won") == 1).cast("long")).alias("conversions")
    )


def subset_sums(sets: DataFrame, n_channels: int, names: Sequence[str]) -> DataFrame:
    """For each of the 2^n masks the sums of ``names`` over all its subsets: one pass per channel.

    Pass i adds to each mask with channel i the sums of the mask without it.
    """
    masks = sets.sparkSession.range(1 << n_channels).select(F.col("id").cast("int").alias("mask"))
    sums = masks.join(sets, "mask", "left").select("mask", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    for i in range(n_channels):
        into = F.array_distinct(F.array("mask", F.col("mask").bitwiseOR(F.lit(1 << i))))
        sums = sums.select(F.explode(into).alias("mask"), *names).groupBy("mask").agg(*[F.sum(n).alias(n) for n in names])
    return sums


def _weight(n_channels: int) -> Column:
    """The share of orders in which the other channels of a set of ``size`` come just before the channel."""
    return F.element_at(
        F.array(*[F.lit(factorial(s - 1) * factorial(n_channels - s) / factorial(n_channels)) for s in range(1, n_channels + 1)]),
        F.col("size"),
    )


def shapley(
    events: DataFrame,
    key: Sequence[str] = ("uid",),
    value: str = CONVERSIONS,
    channels: Sequence[str] | None = None,
    order: Sequence[str] = ORDER,
    max_channels: int = MAX_CHANNELS,
) -> DataFrame:
    """channel, its Shapley ``credit`` and its share of all credit.

    A set of channels is worth the conversions of the journeys that touch no channel outside it
    (``value="conversions"``), or the share of these journeys that convert (``"rate"``; 0 for no
    journey). Credits add up to the worth of all channels less that of none. Events without a
    channel belong to no set. More than ``max_channels`` channels are an error.
    """
    if value not in (CONVERSIONS, RATE):
        raise ValueError(f"value is {value!r}, not {CONVERSIONS!r} or {RATE!r}")
    channels = known_channels(events, max_channels) if channels is None else list(channels)
    if len(channels) > max_channels:
        raise TooManyChannelsError(f"{len(channels)} channels; at most {max_channels}")
    sums = subset_sums(channel_sets(events, channels, key, order), len(channels), ["journeys", "conversions"])
    worth = F.col("conversions").cast("double")
    if value == RATE:
        worth = F.coalesce(ratio(worth, F.col("journeys")), F.lit(0.0))
    worths = sums.select("mask", worth.alias("worth"))
    names = F.array(*[F.struct(F.lit(name).alias("channel"), F.lit(1 << i).alias("bit")) for i, name in enumerate(channels)])
    # A set with the channel gains, the same set without it loses; both carry the number of the larger one.
    each = worths.select("mask", "worth", F.explode(names).alias("c")).select("mask", "worth", "c.*")
    has = F.col("mask").bitwiseAND(F.col("bit")) != 0
    size = F.bit_count("mask") + F.when(has, 0).otherwise(1)
    gains = each.withColumns({"size": size, "sign": F.when(has, 1.0).otherwise(-1.0)})
    credit = gains.groupBy("channel").agg(F.sum(F.col("sign") * F.col("worth") * _weight(len(channels))).alias("credit"))
    return credit.withColumn("share", ratio(F.col("credit"), F.sum("credit").over(Window.partitionBy(F.lit(1)))))
