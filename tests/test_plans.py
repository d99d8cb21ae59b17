"""What the plans must not contain, and how often they may shuffle."""

import re

import pytest
from conftest import DATA
from creditpath.plans.queries import queries

ROW_GRAIN = [
    "bernoulli_click", "cost_enrich", "user_preferences", "user_activity", "user_journey", "first_last_touch", "visit_profile",
    "customer_contribution", "silver_visits", "silver_summary", "user_totals", "hash_split", "transitions",
    "transition_matrix", "user_transition_matrix", "user_state_probabilities", "state_exposure",
    "browse_probability", "user_risk", "user_product_funnel", "user_end_states", "transition_summary",
    "conversions_by_date", "ad_spend_exploded", "interaction_counts",
]


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanges(text):
    """The shuffles by kind, from the node list of a formatted plan."""
    return re.findall(r"^Arguments: (hashpartitioning|rangepartitioning|SinglePartition)", text, re.M)


@pytest.mark.parametrize("name", ROW_GRAIN)
def test_no_python_no_cross_join(spark, name):
    text = plan(queries()[name](spark, f"{DATA}/sf0.001"))
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapInPandas|CartesianProduct", text)
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name",
    ["transitions", "visit_profile", "customer_contribution", "user_transition_matrix", "user_product_funnel", "user_end_states"],
)
def test_journey_steps_share_the_shuffle_of_the_event_log(spark, name):
    assert exchanges(plan(queries()[name](spark, f"{DATA}/sf0.001"))) == ["hashpartitioning"]


def test_rates_clicks_and_split_need_no_shuffle_of_their_own(spark):
    for name in ("bernoulli_click", "cost_enrich", "hash_split"):
        text = plan(queries()[name](spark, f"{DATA}/sf0.001"))
        assert set(exchanges(text)) == {"hashpartitioning"}
        assert "Aggregate" not in text
    # Without the journey key not even the window over the log remains.
    assert exchanges(plan(queries()["rate_lookup"](spark, f"{DATA}/sf0.001"))) == []


def test_scan_reads_what_the_query_needs(spark):
    text = plan(queries()["bronze_scan"](spark, f"{DATA}/sf0.001"))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text
    assert "EqualTo(event_type,purchase)" in text
    text = plan(queries()["user_totals"](spark, f"{DATA}/sf0.001"))
    assert "value" not in re.search("ReadSchema: (.*)", text).group(1)
