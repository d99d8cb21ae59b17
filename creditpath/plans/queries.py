"""Named queries over a data folder, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditpath import fixed_values as fv
from creditpath.functions import calendar_features, ctr_of_rank, like_of_stars
from creditpath.operators import allocation, enrich, explore, journeys, markov, model, risk, scoring, sessions, shapley
from creditpath.operators import spend, touches, visits
from creditpath.plans.stages import KEYED, Stages, named
from creditpath.session import scratch_path
from creditpath.sources import tables
from creditpath.sources.bucketed import BucketedTable, newest_rows
from creditpath.sources.dated import DatedTable
from creditpath.sources.event_log import JOURNEY, read_events, with_channel
from creditpath.sources.raw_log import typed, write_raw
from creditpath.sources.schemas import BRONZE
from creditpath.streaming.dated import ingest_dated
from creditpath.streaming.ingest import ingest, stream_raw
from creditpath.streaming.upsert import stream_upsert as merge_stream
from creditpath.streaming.windows import stream_conversions

Query = Callable[[SparkSession, str], DataFrame]
_STEPS: dict[str, Callable[[Stages], DataFrame]] = {}


def query(step: Callable[[Stages], DataFrame]) -> Callable[[Stages], DataFrame]:
    _STEPS[step.__name__] = step
    return step


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as decimals, so that neither the order of additions nor a last binary digit shows."""

    def short(name: str) -> Column:
        as_decimal = F.col(f"`{name}`").try_cast("decimal(38,12)")
        return F.coalesce(F.round(as_decimal, digits).cast("double"), F.col(f"`{name}`")).alias(name)

    return rows.select(*[short(name) if kind == "double" else F.col(f"`{name}`") for name, kind in rows.dtypes])


def queries() -> dict[str, Query]:
    return {name: _runner(step) for name, step in _STEPS.items()}


def _runner(step: Callable[[Stages], DataFrame]) -> Query:
    return lambda spark, data_dir: rounded(step(Stages(spark, data_dir)))


# --- Ingest and enrichment


@query
def bronze_ingest(s: Stages) -> DataFrame:
    source, sink, seen = (scratch_path(s.spark, part) for part in ("raw", "bronze", "seen"))
    write_raw(s.events, source)
    return ingest(s.spark, source, sink, seen)


@query
def rate_lookup(s: Stages) -> DataFrame:
    rows = s.events.select("event_id", "channel", "product_stars")
    rows = enrich.rate_lookup(rows, "channel", fv.CPM, "cpm")
    rows = enrich.rate_lookup(rows, "channel", fv.CPC, "cpc")
    return enrich.rate_lookup(rows, "product_stars", fv.ORDER_VALUE, "order_value")


@query
def ctr_curve(s: Stages) -> DataFrame:
    drawn = enrich.with_preferences(s.events).groupBy("ctr_rank", "product_stars").agg(F.count(F.lit(1)).alias("n_events"))
    return drawn.withColumns(
        {"ctr_perc": ctr_of_rank(F.col("ctr_rank")), "like_perc": like_of_stars(F.col("product_stars"))}
    )


@query
def user_preferences(s: Stages) -> DataFrame:
    return enrich.user_preferences(named(s.ends).select("uid"))


@query
def bernoulli_click(s: Stages) -> DataFrame:
    return enrich.bernoulli_click(s.events).select(
        "event_id", "uid", "product_stars", "ctr_rank", "ctr_perc", "like_perc", "ctr", "click"
    )


@query
def cost_enrich(s: Stages) -> DataFrame:
    return s.costed.select("event_id", "uid", "channel", "click", "impression", "cpm", "cpi", "cpc", "gpt")


def _arrivals(s: Stages) -> list[DataFrame]:
    """The events in two deliveries: the earlier half of the time, and the later one with a tenth of the earlier."""
    second = F.unix_micros(F.date_trunc("second", F.col("time").cast("timestamp"))) / F.lit(1_000_000)
    events = s.events.withColumn("_second", second.cast("long"))
    cut = events.agg(F.floor((F.min("_second") + F.max("_second")) / 2)).scalar()
    first = (F.col("_second") <= cut) & (F.col("event_id") % 10 != 0)
    return [events.where(first).drop("_second"), events.where(~first).drop("_second")]


@query
def hourly_conversions(s: Stages) -> DataFrame:
    """Conversions by hour and channel from two deliveries, events six hours behind the last one left out."""
    source, sink, state = (scratch_path(s.spark, part) for part in ("late", "hours", "state"))
    for number, rows in enumerate(_arrivals(s)):
        write_raw(rows, f"{source}/delivery={number}")
        hours = stream_conversions(s.spark, f"{source}/delivery=*", sink, state)
    return hours


def _dated(s: Stages) -> DatedTable:
    """Bronze by date from two deliveries, a few files per micro-batch, compacted after the first one."""
    source, seen, path = (scratch_path(s.spark, part) for part in ("raw", "seen", "dated"))
    table = DatedTable(s.spark, path, BRONZE)
    table.create()
    for number, rows in enumerate(_arrivals(s)):
        write_raw(rows.repartition(4), f"{source}/delivery={number}")
        ingest_dated(table, f"{source}/delivery=*", seen, 3)
        if number == 0:
            table.compact()
    return table


@query
def dated_bronze(s: Stages) -> DataFrame:
    return _dated(s).read()


@query
def compacted_bronze_days(s: Stages) -> DataFrame:
    """Events and conversions of the last seven days of bronze, which are the only ones that are read."""
    table = _dated(s)
    table.compact()
    rows = table.read()
    last = rows.agg(F.max("day")).scalar()
    recent = rows.where(F.col("day") > F.date_sub(last, 7))
    return recent.groupBy("day").agg(F.count(F.lit(1)).alias("n_events"), F.sum("conversion").alias("n_conversions"))


def _last_seen(rows: DataFrame) -> DataFrame:
    """Events as last-seen rows of their users."""
    seconds = F.date_trunc("second", F.col("time").cast("timestamp")).cast("timestamp_ntz").alias("time")
    return rows.select(F.col("user_id").cast("string").alias("uid"), seconds, "conversion", "interaction", "channel")


_NEWEST = ["time", "conversion", "interaction", "channel"]


@query
def bucketed_merge(s: Stages) -> DataFrame:
    """What each user did last: known for one delivery, then merged with the next, which has older events too."""
    known, late = (newest_rows(_last_seen(rows), ["uid"], _NEWEST) for rows in _arrivals(s))
    table = BucketedTable(s.spark, scratch_path(s.spark, "last-seen"), ["uid"], buckets=16)
    table.create(known)
    table.merge(late, _NEWEST)
    return table.read()


@query
def stream_upsert(s: Stages) -> DataFrame:
    """The same from a stream of raw files, a few per micro-batch."""
    source, state, path = (scratch_path(s.spark, part) for part in ("raw", "state", "last-seen"))
    table = BucketedTable(s.spark, path, ["uid"], buckets=16)
    for number, rows in enumerate(_arrivals(s)):
        write_raw(rows.withColumn("uid", F.col("user_id").cast("string")).repartition(4), f"{source}/delivery={number}")
        stream = typed(stream_raw(s.spark, f"{source}/delivery=*", 3)).select("uid", *_NEWEST)
        if number == 0:
            table.create(s.spark.createDataFrame([], stream.schema))
        merge_stream(stream, table, state, _NEWEST)
    return table.read()


# --- Exploration metrics


@query
def interaction_counts(s: Stages) -> DataFrame:
    return explore.interaction_counts(s.events)


@query
def channel_share(s: Stages) -> DataFrame:
    return explore.channel_share(s.events)


@query
def user_activity(s: Stages) -> DataFrame:
    return named(explore.user_activity(s.events, JOURNEY))


@query
def distinct_users(s: Stages) -> DataFrame:
    return explore.distinct_users(s.events, JOURNEY)


@query
def journey_lengths(s: Stages) -> DataFrame:
    return explore.journey_lengths(s.events, JOURNEY)


@query
def clicks_by_rank_stars(s: Stages) -> DataFrame:
    return explore.clicks_by_rank_stars(enrich.bernoulli_click(s.events))


@query
def channel_contribution(s: Stages) -> DataFrame:
    return explore.channel_contribution(s.costed)


# --- Journeys and rule-based attribution


def _flat(journey: DataFrame) -> DataFrame:
    order = F.array_join(F.transform("visiting_order", lambda v: v.cast("string")), ",")
    return named(journey).withColumn("visiting_order", order)


@query
def user_journey(s: Stages) -> DataFrame:
    return _flat(journeys.user_journey(s.events, JOURNEY))


@query
def first_last_touch(s: Stages) -> DataFrame:
    return s.touch


@query
def upsert(s: Stages) -> DataFrame:
    """Journeys known at noon of each day, updated by those with events in the afternoon."""
    noon = F.hour("time") < 12
    known = _flat(journeys.user_journey(s.events.where(noon), JOURNEY))
    whole = _flat(journeys.user_journey(s.events, JOURNEY))
    late = named(s.events.where(~noon).select(*JOURNEY).distinct())
    return tables.upsert(known, whole.join(late, "uid", "left_semi"), ["uid"], ["part"])


@query
def clustered_write(s: Stages) -> DataFrame:
    rows = named(s.ends)
    return tables.write_clustered(rows, scratch_path(s.spark, "clustered"), ["uid"])


# --- Visit profile, contribution and ranking


@query
def visit_profile(s: Stages) -> DataFrame:
    return named(s.visits)


@query
def calendar(s: Stages) -> DataFrame:
    return s.events.select("event_id", "time").withColumns(calendar_features(F.col("time")))


@query
def customer_contribution(s: Stages) -> DataFrame:
    return s.contributions.drop(*JOURNEY)


@query
def product_contribution(s: Stages) -> DataFrame:
    sums = explore.contribution(s.visits, ["product_stars"], visits.BID_COLUMNS)
    return explore.ranked_by_return(sums, "product_rank")


@query
def channel_contribution_ranked(s: Stages) -> DataFrame:
    sums = explore.contribution(s.visits, ["channel"], visits.BID_COLUMNS)
    return explore.ranked_by_return(sums, "channel_rank")


@query
def visit_rank(s: Stages) -> DataFrame:
    return visits.visit_rank(s.contributions, JOURNEY).drop(*JOURNEY)


@query
def rank_extremes(s: Stages) -> DataFrame:
    return visits.rank_extremes(visits.visit_rank(s.contributions, JOURNEY))


@query
def channel_clicks_and_customers(s: Stages) -> DataFrame:
    return visits.channel_clicks_and_customers(
        explore.contribution(s.visits, ["channel"], visits.BID_COLUMNS), s.events
    )


@query
def click_deciles(s: Stages) -> DataFrame:
    return visits.click_deciles(s.contributions)


@query
def silver_visits(s: Stages) -> DataFrame:
    return s.silver.drop(*JOURNEY)


@query
def user_totals(s: Stages) -> DataFrame:
    return s.user_totals.drop(*JOURNEY)


@query
def segment_revenue(s: Stages) -> DataFrame:
    return visits.segment_revenue(s.user_totals, s.ranks, JOURNEY)


@query
def impression_percentiles(s: Stages) -> DataFrame:
    return visits.impression_percentiles(s.user_totals)


@query
def silver_summary(s: Stages) -> DataFrame:
    return s.summary.drop(*JOURNEY)


@query
def daily_user_rollup(s: Stages) -> DataFrame:
    return visits.daily_user_rollup(s.summary, KEYED).drop(*JOURNEY)


@query
def quality_checks(s: Stages) -> DataFrame:
    return visits.quality_checks(s.silver, s.summary)


@query
def clicks_over_impressions(s: Stages) -> DataFrame:
    return visits.clicks_over_impressions(s.summary).drop(*JOURNEY)


@query
def hash_split(s: Stages) -> DataFrame:
    parts = enrich.hash_split(s.events.select("event_id", "uid"), "uid", {"train": 0.8, "val": 0.2})
    train, val = (rows.withColumn("part", F.lit(name)) for name, rows in parts.items())
    return train.unionByName(val)


# --- Markov attribution


@query
def transitions(s: Stages) -> DataFrame:
    return named(s.transitions)


@query
def transition_matrix(s: Stages) -> DataFrame:
    return markov.transition_matrix(s.transitions)


@query
def matrix_row_sums(s: Stages) -> DataFrame:
    return markov.matrix_row_sums(s.matrix)


@query
def matrix_pivot(s: Stages) -> DataFrame:
    return markov.matrix_pivot(s.matrix, [*fv.TOUCH_WEIGHTS, fv.CONVERSION, fv.NULL])


@query
def matrix_stats(s: Stages) -> DataFrame:
    return markov.matrix_stats(s.matrix)


@query
def end_states(s: Stages) -> DataFrame:
    return markov.end_states(s.matrix)


@query
def staying_stats(s: Stages) -> DataFrame:
    return markov.staying_stats(s.matrix)


@query
def removal_graph(s: Stages) -> DataFrame:
    return markov.removal_graphs(s.matrix)


@query
def removal_adjacency(s: Stages) -> DataFrame:
    lists = markov.adjacency(markov.removal_graphs(s.matrix))
    sizes = F.aggregate("next_stage_transition_probabilities", F.lit(0.0), lambda a, p: a + p)
    return lists.select(
        "removed", "start_state", F.array_join("next_stages", ",").alias("next_stages"), sizes.alias("total_probability")
    )


@query
def conversion_probability(s: Stages) -> DataFrame:
    return s.conversion_probability("simple_path")


@query
def conversion_probability_absorbing(s: Stages) -> DataFrame:
    return s.conversion_probability("absorbing")


@query
def removal_effect(s: Stages) -> DataFrame:
    return s.removal_effect("simple_path")


@query
def removal_effect_absorbing(s: Stages) -> DataFrame:
    return s.removal_effect("absorbing")


@query
def markov_attribution(s: Stages) -> DataFrame:
    return markov.markov_attribution(s.removal_effect())


@query
def attribution_upsert(s: Stages) -> DataFrame:
    """First and last touch, then the Markov shares merged in by model and channel."""
    columns = ["attribution_model", "channel", "attribution_percent"]
    chain = markov.markov_attribution(s.removal_effect()).select(*columns)
    return tables.upsert(s.touch.select(*columns), chain, columns[:2])


# --- Multi-touch and Shapley attribution, journeys by pauses


@query
def multi_touch(s: Stages) -> DataFrame:
    """Linear and time-decay credit; a touch loses half of its weight in two hours."""
    return touches.multi_touch(s.events, JOURNEY, half_life=2 * 3600)


@query
def shapley_attribution(s: Stages) -> DataFrame:
    """Shapley credit of the channels for conversions and for the rate of conversion."""
    models = []
    for value in (shapley.CONVERSIONS, shapley.RATE):
        credit = shapley.shapley(s.events, JOURNEY, value)
        models.append(credit.select(F.lit(f"shapley_{value}").alias("attribution_model"), "channel", "credit", "share"))
    return models[0].unionByName(models[1])


@query
def session_journeys(s: Stages) -> DataFrame:
    """Journeys that end with a pause of more than twelve hours."""
    rows = sessions.session_journeys(s.events, gap=12 * 3600, hot_rows=s.hot_rows)
    order = F.array_join(F.transform("visiting_order", lambda v: v.cast("string")), ",")
    return rows.withColumn("visiting_order", order)


# --- Per-user transitions and risk


@query
def user_transition_matrix(s: Stages) -> DataFrame:
    return named(s.user_matrix)


@query
def user_state_probabilities(s: Stages) -> DataFrame:
    return risk.with_total_rows(named(s.probabilities))


@query
def state_exposure(s: Stages) -> DataFrame:
    return named(risk.state_exposure(s.probabilities, JOURNEY))


@query
def browse_by_state(s: Stages) -> DataFrame:
    return named(risk.browse_by_state(risk.state_exposure(s.probabilities, JOURNEY), JOURNEY))


@query
def browse_probability(s: Stages) -> DataFrame:
    return named(s.browse)


@query
def user_row_sums(s: Stages) -> DataFrame:
    return named(risk.user_row_sums(s.probabilities, JOURNEY))


@query
def channel_risk_score(s: Stages) -> DataFrame:
    return named(s.risk_scores)


@query
def user_risk(s: Stages) -> DataFrame:
    return named(s.user_risk)


@query
def segment_risk_aversion(s: Stages) -> DataFrame:
    return risk.segment_risk_aversion(s.user_risk)


@query
def user_product_funnel(s: Stages) -> DataFrame:
    return named(risk.user_product_funnel(s.visits, JOURNEY))


@query
def user_end_states(s: Stages) -> DataFrame:
    return named(risk.user_end_states(s.probabilities, JOURNEY))


@query
def end_state_conversion(s: Stages) -> DataFrame:
    return risk.end_state_conversion(risk.user_end_states(s.probabilities, JOURNEY))


@query
def transition_summary(s: Stages) -> DataFrame:
    return risk.transition_summary(s.probabilities)


@query
def edges_per_user(s: Stages) -> DataFrame:
    return named(risk.edges_per_user(s.user_matrix, JOURNEY))


@query
def transitions_per_user(s: Stages) -> DataFrame:
    return named(risk.transitions_per_user(s.risk_scores, JOURNEY))


@query
def converting_edges(s: Stages) -> DataFrame:
    return named(risk.converting_edges(s.user_matrix))


# --- Spend reports


@query
def ad_spend_exploded(s: Stages) -> DataFrame:
    """Each user's day as a campaign that spends the value of its events on their channels."""
    spent = with_channel(read_events(s.spark, s.data_dir)).select(
        F.concat_ws("-", "user_id", F.to_date("ts")).alias("campaign_id"),
        "channel",
        F.col("value").alias("spend"),
        F.col("ts").alias("time"),
    )
    return spend.ad_spend_exploded(spend.spend_table(spent))


@query
def base_conversion_rate(s: Stages) -> DataFrame:
    return spend.base_conversion_rate(s.ends)


@query
def conversions_by_date(s: Stages) -> DataFrame:
    return spend.conversions_by_date(s.events)


@query
def attributed_conversions(s: Stages) -> DataFrame:
    return spend.attributed_conversions(s.attribution, s.ends)


@query
def cost_per_acquisition(s: Stages) -> DataFrame:
    return spend.cost_per_acquisition(s.campaign_spend, spend.attributed_conversions(s.attribution, s.ends))


@query
def budget_reallocation(s: Stages) -> DataFrame:
    return spend.budget_reallocation(s.campaign_spend, s.attribution)


@query
def current_and_proposed(s: Stages) -> DataFrame:
    return spend.current_and_proposed(s.campaign_spend, spend.budget_reallocation(s.campaign_spend, s.attribution))


# --- Prediction, scoring and optimization


@query
def impressions_model(s: Stages) -> DataFrame:
    return model.model_report(s.split["train"], s.split["val"])


@query
def score_bid_units(s: Stages) -> DataFrame:
    return s.bid_units


@query
def score_bid_units_by_segment(s: Stages) -> DataFrame:
    return scoring.score_bid_units(s.split["val"], rank_on="segment")


@query
def visit_scores(s: Stages) -> DataFrame:
    return scoring.visit_scores(s.browse, s.ranks, JOURNEY)


@query
def risk_seeker_score(s: Stages) -> DataFrame:
    return s.seeker


@query
def expected_kpis(s: Stages) -> DataFrame:
    return s.kpis


@query
def scale_constants(s: Stages) -> DataFrame:
    return scoring.scale_constants(s.kpis)


_ALLOCATION = [*scoring.BID_UNIT, "spend", "revenue", "v", "w", "x", "opt_result"]


@query
def allocate_budget(s: Stages) -> DataFrame:
    return s.chosen("revenue").select(*_ALLOCATION)


@query
def allocate_budget_with_risk(s: Stages) -> DataFrame:
    return s.chosen("risk").select(*_ALLOCATION)


@query
def allocate_with_missing_rates(s: Stages) -> DataFrame:
    """The allocation where the rates of one channel are not known: its units are kept, with nothing spent on them."""
    known = s.kpis.withColumn("spend", F.when(F.col("channel") != "Affiliates", F.col("spend")))
    return allocation.allocate(known, allocation.revenue_value()).select(*_ALLOCATION)


@query
def allocation_summary(s: Stages) -> DataFrame:
    return allocation.allocation_summary(s.chosen("revenue"))


# --- Tables as they are read


@query
def bronze_scan(s: Stages) -> DataFrame:
    """The raw table by event type, with the filter and columns pushed to the scan."""
    rows = read_events(s.spark, s.data_dir).where(F.col("event_type") == "purchase")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users"))
