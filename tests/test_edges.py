"""Empty input, one-touch journeys, ties, unknown channels, zero cost, no conversions."""

import datetime as dt

import pytest
from conftest import rows_of
from creditpath import fixed_values as fv
from creditpath.functions import ctr_of_rank, hash01, like_of_stars
from creditpath.operators import enrich, explore, journeys, markov, model, risk, scoring, spend, visits
from creditpath.plans.skew import hot_key_cuts
from pyspark.sql import functions as F

SCHEMA = (
    "uid string, event_id long, time timestamp_ntz, interaction string, channel string, "
    "conversion int, click int, product_stars int"
)
NOON = dt.datetime(2020, 5, 17, 12)


def events(spark, journeys_):
    """Events from {uid: [(minute, channel, conversion)]}."""
    rows, n = [], 0
    for uid, steps in journeys_.items():
        for minute, channel, conversion in steps:
            kind = "conversion" if conversion else "impression"
            rows.append((uid, n, NOON + dt.timedelta(minutes=minute), kind, channel, conversion, conversion, 1 + n % 5))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def some(spark):
    return events(
        spark,
        {
            "one": [(0, "Email", 0)],
            "won": [(0, "Email", 1)],
            "tie": [(5, "Email", 0), (5, "Affiliates", 0), (9, "Email", 1)],
            "odd": [(0, "Billboard", 0), (1, "Email", 0)],
        },
    )


def test_journeys(some):
    found = {r.uid: r for r in journeys.user_journey(some).collect()}
    assert found["one"].path == "Start > Email > Null"
    assert found["won"].path == "Start > Email > Conversion"
    assert found["tie"].path == "Start > Email > Affiliates > Email > Conversion"
    assert found["tie"].visiting_order == [1, 1, 2]
    assert {r.part for r in found.values()} == {0}


def test_one_touch_without_conversion_has_no_browse_probability(some):
    browse = risk.browse_probability(journeys.journey_ends(some))
    assert {r.uid: round(r.prob_to_browse, 6) for r in browse.collect()} == {"won": 0.5, "tie": 0.75, "odd": 0.333333}
    scores = some.sparkSession.createDataFrame(
        [("one", "Email", 2, 1.0)], "uid string, start_state string, total_transitions_per_user int, risk_score double"
    )
    ranks = some.sparkSession.createDataFrame([("one", 1)], "uid string, VISIT_RANK2 int")
    assert risk.user_risk(scores, ranks, browse).first().prob_to_browse == 1.0


def test_unknown_channels_have_no_rate(some):
    costed = enrich.cost_enrich(some)
    assert [r.cpm for r in costed.where("channel = 'Billboard'").collect()] == [None]
    per_channel = {r.channel: r for r in explore.channel_contribution(costed).collect()}
    assert per_channel["Billboard"].ROAS is None
    assert per_channel["Email"].sum_cpc == pytest.approx(5 * 0.91)


def test_zero_cost_has_no_return(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0, 5.0)], "k string, cpi double, cpc double, gpt double")
    assert explore.contribution(rows, ["k"], ["cpi", "cpc", "gpt"]).first().ROAS is None


def test_rates_as_table_and_as_long_mapping_equal_the_literal(spark, some):
    literal = enrich.rate_lookup(some, "channel", fv.CPM, "cpm")
    table = spark.createDataFrame(list(fv.CPM.items()), "channel string, cpm double")
    long = fv.CPM | {f"x{i}": 1.0 for i in range(100)}
    assert rows_of(literal) == rows_of(enrich.rate_lookup(some, "channel", table, "cpm"))
    assert rows_of(literal) == rows_of(enrich.rate_lookup(some, "channel", long, "cpm"))


def test_curves(spark):
    ranks = spark.range(10).select(ctr_of_rank(F.col("id")).alias("c")).orderBy(F.desc("c")).collect()
    assert [r.c for r in ranks] == pytest.approx([0.12, 0.1116, 0.0876, 0.06, 0.0348, 0.018, 0.0072, 0.0024, 0.0012, 0.0])
    likes = spark.range(1, 6).select(like_of_stars(F.col("id")).alias("l")).orderBy(F.desc("l")).collect()
    assert [r.l for r in likes] == pytest.approx([0.85, 0.53, 0.24, 0.08, 0.02])


def test_joined_and_computed_preferences_click_alike(some):
    prefs = enrich.user_preferences(some.select("uid").distinct())
    assert prefs.count() == 20
    assert rows_of(enrich.bernoulli_click(some)) == rows_of(enrich.bernoulli_click(some, prefs))
    assert enrich.bernoulli_click(some).where("conversion = 1 AND click = 0").isEmpty()


def test_hash_split_keeps_keys_together_and_loses_none(spark):
    rows = spark.range(5000).select((F.col("id") % 1000).cast("string").alias("uid"), "id")
    parts = enrich.hash_split(rows, "uid", {"a": 6, "b": 3, "c": 1})
    counts = {n: p.count() for n, p in parts.items()}
    assert sum(counts.values()) == 5000 and counts["a"] > counts["b"] > counts["c"] > 0
    assert parts["a"].join(parts["b"], "uid", "left_semi").isEmpty()
    assert rows_of(parts["c"]) == rows_of(enrich.hash_split(rows.repartition(7), "uid", {"a": 6, "b": 3, "c": 1})["c"])
    draws = rows.select(hash01(F.col("uid"), "s").alias("u")).agg(F.min("u"), F.max("u")).first()
    assert 0 <= draws[0] and draws[1] < 1


def test_empty_events(spark, some):
    none = some.limit(0)
    assert hot_key_cuts(none, ["uid"], ["time", "event_id"]) is None
    assert journeys.user_journey(none).isEmpty()
    assert journeys.first_last_touch(journeys.journey_ends(none)).isEmpty()
    assert markov.transition_matrix(journeys.transitions(none)).isEmpty()
    costed = enrich.cost_enrich(none)
    profile = visits.visit_profile(costed)
    assert visits.visit_rank(visits.customer_contribution(profile)).isEmpty()
    assert spend.base_conversion_rate(journeys.journey_ends(none)).isEmpty()


def test_no_conversions_share_nothing(spark):
    lost = events(spark, {"a": [(0, "Email", 0)], "b": [(0, "Affiliates", 0)]})
    ends = journeys.journey_ends(lost)
    assert journeys.first_last_touch(ends).isEmpty()
    attribution = spark.createDataFrame([("m", "Email", 0.5)], "attribution_model string, channel string, attribution_percent double")
    attributed = spend.attributed_conversions(attribution, ends)
    spent = spend.ad_spend_exploded(spend.campaign(spark))
    assert spend.cost_per_acquisition(spent, attributed).first().CPA_in_Dollars is None


def test_threshold_of_zero_and_deviation_of_one_row(spark):
    rows = [("a", "Email", 10), ("b", "Email", 1), ("c", "Email", 1), ("a", "Solo", 10), ("a", "Start", 10)]
    probabilities = spark.createDataFrame(rows, "uid string, start_state string, total_transitions_per_user long")
    found = {(r.uid, r.start_state): r for r in risk.channel_risk_score(probabilities).collect()}
    assert ("a", "Start") not in found
    assert found["a", "Email"].thresh_per_channel == 0.0 and found["a", "Email"].risk_score is None
    assert found["a", "Solo"].std_transitions_per_channel is None and found["a", "Solo"].thresh_per_channel == 0.0


def test_visits_of_equal_rows_are_one(spark):
    twice = events(spark, {"u": [(0, "Email", 0)] * 11})
    profile = visits.visit_profile(enrich.cost_enrich(twice)).collect()
    assert len(profile) == 5 and {r.visit_impr for r in profile} == {11}


def test_model_on_a_small_grid(spark):
    rows = spark.range(400).select(
        F.concat(F.lit("u"), F.col("id")).alias("uid"),
        F.lit(NOON).alias("time"),
        F.element_at(F.array(*[F.lit(c) for c in fv.CPM]), (F.col("id") % 5 + 1).cast("int")).alias("channel"),
        (F.col("id") % 5 + 1).cast("int").alias("product_stars"),
        (F.col("id") % 7).alias("visit_impr"),
        (F.col("id") % 7 + F.col("id") % 3).alias("visit_clicks"),
        (F.col("id") % 2).alias("visit_txns"),
        F.lit(None).cast("double").alias("max_cpm"),
        F.lit(0.1).alias("avg_cpi"),
        F.lit(0.2).alias("bid_cpc"),
        F.lit(1.0).alias("gpt"),
        F.lit(5).alias("month"),
        F.lit(1).alias("dayofweek"),
        F.lit(20).alias("weekofyear"),
        F.col("id").alias("timestamp"),
        F.lit(3).alias("sum_visit_impr"),
        F.lit(1).alias("VISIT_RANK2"),
    )
    assert model.columns_of_type(rows, "string") == ["uid", "channel"]
    parts = enrich.hash_split(rows, "uid", {"train": 0.8, "val": 0.2})
    report = model.model_report(parts["train"], parts["val"], depths=(2, 3), iterations=(2, 3)).collect()
    errors = {(r.stage, r.part): r.rmse for r in report if r.stage != "grid"}
    assert len(report) == 8 and all(r.rmse > 0 for r in report)
    spread = parts["train"].agg(F.stddev_pop("visit_impr")).first()[0]
    assert errors["default", "train"] < spread and errors["tuned", "train"] < spread

    fitted = model.fit(model.model_input(parts["train"]))
    unseen = parts["val"].withColumn("channel", F.lit("Billboard")).drop("visit_impr")
    assert not fitted.transform(model.model_input(unseen)).where("prediction IS NOT NULL").isEmpty()
    scored = model.predict_impressions(fitted, parts["val"])
    units = scoring.score_bid_units(scored, predictions="impr_hat")
    assert dict(units.dtypes)["impr_pred"] == "double" and units.count() > 0
