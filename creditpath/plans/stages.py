"""The tables of one data folder, each built from the ones before it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from creditpath.operators import allocation, enrich, explore, journeys, markov, risk, scoring, spend, visits
from creditpath.plans.skew import HOT_ROWS
from creditpath.plans.small import pin, settle
from creditpath.sources.event_log import JOURNEY, ad_events, read_events, uid

SPLIT = {"train": 0.8, "val": 0.2}


# The journey columns beside the ``uid`` made of them.
KEYED = (*JOURNEY, "uid")


def with_uid(rows: DataFrame) -> DataFrame:
    return rows.withColumn("uid", uid())


def named(rows: DataFrame) -> DataFrame:
    """Replace the three journey columns by the one ``uid``."""
    return with_uid(rows).drop(*JOURNEY)


class Stages:
    """Lazy DataFrames over the events of ``data_dir``.

    Journey-level steps are keyed by (user, day, leg), so they keep the one
    shuffle on (user, day) that the event log needs anyway. Joins keep it too,
    as they may be partitioned by a part of their keys.
    """

    def __init__(self, spark: SparkSession, data_dir: str, hot_rows: int = HOT_ROWS):
        self.spark = spark
        self.data_dir = data_dir
        self.hot_rows = hot_rows
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    @cached_property
    def events(self) -> DataFrame:
        return ad_events(read_events(self.spark, self.data_dir), self.hot_rows)

    @cached_property
    def costed(self) -> DataFrame:
        return enrich.cost_enrich(self.events)

    @cached_property
    def ends(self) -> DataFrame:
        return journeys.journey_ends(self.events, JOURNEY)

    @cached_property
    def visits(self) -> DataFrame:
        return visits.visit_profile(self.costed, JOURNEY)

    @cached_property
    def contributions(self) -> DataFrame:
        return with_uid(visits.customer_contribution(self.visits, JOURNEY))

    @cached_property
    def ranks(self) -> DataFrame:
        """User ranks, written once: several later steps join them."""
        return pin(visits.visit_rank(self.contributions, JOURNEY))

    @cached_property
    def silver(self) -> DataFrame:
        return with_uid(visits.silver_visits(self.visits, self.ranks, JOURNEY))

    @cached_property
    def summary(self) -> DataFrame:
        return visits.silver_summary(self.silver, KEYED)

    @cached_property
    def split(self) -> dict[str, DataFrame]:
        return enrich.hash_split(self.silver, "uid", SPLIT)

    @cached_property
    def user_totals(self) -> DataFrame:
        return with_uid(visits.user_totals(self.costed, JOURNEY))

    @cached_property
    def transitions(self) -> DataFrame:
        return journeys.transitions(self.events, JOURNEY)

    @cached_property
    def matrix(self) -> DataFrame:
        return settle(markov.transition_matrix(self.transitions))

    def conversion_probability(self, mode: str = "simple_path") -> DataFrame:
        return settle(markov.conversion_probability(markov.removal_graphs(self.matrix), mode))

    def removal_effect(self, mode: str = "simple_path") -> DataFrame:
        return markov.removal_effect(self.conversion_probability(mode))

    @cached_property
    def touch(self) -> DataFrame:
        return journeys.first_last_touch(self.ends)

    @cached_property
    def attribution(self) -> DataFrame:
        """First touch, last touch and Markov shares."""
        columns = ["attribution_model", "channel", "attribution_percent"]
        chain = markov.markov_attribution(self.removal_effect())
        return self.touch.select(*columns).unionByName(chain.select(*columns))

    @cached_property
    def user_matrix(self) -> DataFrame:
        return risk.user_transition_matrix(self.transitions, JOURNEY)

    @cached_property
    def probabilities(self) -> DataFrame:
        return risk.user_state_probabilities(self.user_matrix, JOURNEY)

    @cached_property
    def browse(self) -> DataFrame:
        return risk.browse_probability(self.ends, JOURNEY)

    @cached_property
    def risk_scores(self) -> DataFrame:
        return risk.channel_risk_score(self.probabilities, JOURNEY)

    @cached_property
    def user_risk(self) -> DataFrame:
        return risk.user_risk(self.risk_scores, self.ranks, self.browse, JOURNEY)

    @cached_property
    def campaign_spend(self) -> DataFrame:
        return spend.ad_spend_exploded(spend.campaign(self.spark))

    @cached_property
    def bid_units(self) -> DataFrame:
        return scoring.score_bid_units(self.split["val"])

    @cached_property
    def seeker(self) -> DataFrame:
        aversion = risk.segment_risk_aversion(self.user_risk)
        return scoring.risk_seeker_score(aversion, scoring.visit_scores(self.browse, self.ranks, JOURNEY))

    @cached_property
    def kpis(self) -> DataFrame:
        return settle(scoring.expected_kpis(scoring.with_risk(self.bid_units, self.seeker)))

    def chosen(self, objective: str = "revenue") -> DataFrame:
        if objective == "revenue":
            return allocation.allocate(self.kpis, allocation.revenue_value())
        return allocation.allocate(self.kpis, allocation.risk_adjusted_value(self.kpis))
