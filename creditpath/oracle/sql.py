"""The same results in plain SQL for DuckDB, written from the definitions and not from the Spark code."""

from __future__ import annotations

import re

# Named subqueries, each of which may use the ones before it.
PARTS: dict[str, str] = {}
# The query of each key, over PARTS. Doubles are rounded by ``select``.
RESULTS: dict[str, str] = {}


def _needed(text: str) -> list[str]:
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in words & PARTS.keys() - found:
            found.add(name)
            todo.append(PARTS[name])
    return [name for name in PARTS if name in found]


def oracle_sql() -> dict[str, str]:
    """SQL text by query name."""
    made = {}
    for key, text in RESULTS.items():
        parts = ",\n".join(f"{name} AS (\n{PARTS[name].strip()}\n)" for name in _needed(text))
        made[key] = f"WITH RECURSIVE {parts}\n{text.strip()}" if parts else text.strip()
    return made


def half_up(value: str, digits: int = 6) -> str:
    """A double rounded as a decimal, so that a 5 after the last digit goes up and not by its binary form."""
    return f"cast(round(cast({value} AS decimal(38, 12)), {digits}) AS double)"


def r(*names: str) -> str:
    """Select items that round each named column."""
    return ", ".join(f"{half_up(name)} AS {name}" for name in names)


def exact_sum(value: str) -> str:
    return f"cast(sum(cast({value} AS decimal(28, 12))) AS double)"


def exact_mean(value: str) -> str:
    return f"({exact_sum(value)} / count({value}))"


# --- Event log

PARTS["t_base"] = """
SELECT *, concat(cast(user_id AS varchar), '-', cast(cast(ts AS date) AS varchar)) AS ud,
       cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k,
       CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS conversion
FROM events
"""
PARTS["t_legs"] = """
SELECT *, coalesce(sum(conversion) OVER (PARTITION BY ud ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j
FROM t_base
"""
PARTS["t_ev"] = """
SELECT concat(ud, '-', cast(j AS varchar)) AS uid, ud, value, event_id, ts AS time,
       CASE WHEN conversion = 1 THEN 'conversion' ELSE 'impression' END AS interaction,
       CASE WHEN k < 20 THEN 'Social Network' WHEN k < 50 THEN 'Search Engine Marketing'
            WHEN k < 65 THEN 'Google Display Network' WHEN k < 95 THEN 'Affiliates' ELSE 'Email' END AS channel,
       conversion, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS click,
       cast(1 + event_id % 5 AS int) AS product_stars
FROM t_legs
"""
PARTS["t_cpm"] = """
SELECT * FROM (VALUES ('Social Network', 8.0::double, 0.92::double), ('Search Engine Marketing', 2.43, 2.62),
       ('Google Display Network', 3.12, 0.63), ('Affiliates', 20.0, 0.88), ('Email', 15.0, 0.91)) AS t(channel, cpm, cpc)
"""
PARTS["t_value"] = """
SELECT * FROM (VALUES (5, 209.085::double), (4, 174.2375), (3, 69.695), (2, 34.8475), (1, 10.45425))
       AS t(product_stars, order_value)
"""
PARTS["t_cost"] = """
SELECT t_ev.*, CASE WHEN interaction = 'impression' THEN 1 ELSE 0 END AS impression,
       cpm, cpm / 1000 AS cpi, cpc, CASE WHEN conversion = 1 THEN order_value ELSE 0.0::double END AS gpt
FROM t_ev JOIN t_cpm USING (channel) JOIN t_value USING (product_stars)
"""


def draw(text: str) -> str:
    return f"(cast(('0x' || substr(md5(concat({text})), 1, 8)) AS ubigint) / 4294967296.0::double)"


PARTS["t_pref"] = f"""
SELECT *, 0.12::double * round(exp(-power(ctr_rank * 2.5::double / 9, 2)), 2) AS ctr_perc,
       round(exp(-power((6 - product_stars) * 0.4::double, 2)), 2) AS like_perc
FROM (SELECT uid, product_stars, cast(floor({draw("uid, '|ctr'")} * 10) AS int) AS ctr_rank
      FROM (SELECT DISTINCT uid FROM t_ev) u CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS product_stars) p) q
"""
PARTS["t_click"] = f"""
SELECT event_id, uid, product_stars, ctr_rank, ctr_perc, like_perc, ctr,
       CASE WHEN conversion = 1 THEN 1
            WHEN {draw("cast(event_id AS varchar), '|click'")} < ctr * 1.3::double THEN 1 ELSE 0 END AS click
FROM (SELECT *, ctr_perc * 1.3::double * like_perc AS ctr FROM t_pref) p
JOIN (SELECT event_id, uid, product_stars, conversion FROM t_ev) e USING (uid, product_stars)
"""

RESULTS["bronze_ingest"] = "SELECT uid, date_trunc('second', time) AS time, interaction, channel, conversion FROM t_ev"
RESULTS["dated_bronze"] = """
SELECT uid, date_trunc('second', time) AS time, interaction, channel, conversion, cast(time AS date) AS day FROM t_ev
"""
RESULTS["compacted_bronze_days"] = """
SELECT cast(time AS date) AS day, count(*) AS n_events, cast(sum(conversion) AS bigint) AS n_conversions
FROM t_ev WHERE cast(time AS date) > (SELECT max(cast(time AS date)) FROM t_ev) - 7 GROUP BY ALL
"""
RESULTS["rate_lookup"] = """
SELECT event_id, channel, product_stars, cpm, cpc, order_value
FROM t_ev JOIN t_cpm USING (channel) JOIN t_value USING (product_stars)
"""
RESULTS["ctr_curve"] = f"""
SELECT ctr_rank, product_stars, count(*) AS n_events, {r("ctr_perc", "like_perc")}
FROM t_click GROUP BY ctr_rank, product_stars, ctr_perc, like_perc
"""
RESULTS["user_preferences"] = f"""
SELECT uid, product_stars, ctr_rank, {r("ctr_perc", "like_perc")}, cast(round(cast(ctr_perc * 1.3::double * like_perc AS decimal(38, 12)), 6) AS double) AS ctr
FROM t_pref
"""
RESULTS["bernoulli_click"] = f"""
SELECT event_id, uid, product_stars, ctr_rank, {r("ctr_perc", "like_perc", "ctr")}, click FROM t_click
"""
RESULTS["cost_enrich"] = f"SELECT event_id, uid, channel, click, impression, {r('cpm', 'cpi', 'cpc', 'gpt')} FROM t_cost"

# --- Exploration metrics

RESULTS["interaction_counts"] = "SELECT interaction, count(*) AS count FROM t_ev GROUP BY interaction"
RESULTS["channel_share"] = """
SELECT channel, count(*) AS count, (SELECT count(*) FROM t_ev) AS total_cnt,
       cast(round(cast(count(*) / (SELECT count(*) FROM t_ev)::double AS decimal(38, 12)), 6) AS double) AS p_channel FROM t_ev GROUP BY channel
"""
RESULTS["user_activity"] = """
SELECT uid, count(*) AS count, (SELECT count(*) FROM t_ev) AS total_cnt,
       cast(round(cast(count(*) / (SELECT count(*) FROM t_ev)::double AS decimal(38, 12)), 6) AS double) AS p_user FROM t_ev GROUP BY uid
"""
RESULTS["distinct_users"] = "SELECT count(DISTINCT uid) AS n_users FROM t_ev"
RESULTS["journey_lengths"] = """
SELECT count, count(*) AS n_users FROM (SELECT uid, count(*) AS count FROM t_ev GROUP BY uid) q GROUP BY count
"""
RESULTS["clicks_by_rank_stars"] = """
SELECT ctr_rank, product_stars, cast(sum(click) AS bigint) AS sum_click FROM t_click GROUP BY ctr_rank, product_stars
"""


def contribution(table: str, key: str, columns: list[str], whole: set[str]) -> str:
    sums = ", ".join(
        f"cast(sum({c}) AS bigint) AS sum_{c}" if c in whole else f"sum({c}) AS sum_{c}" for c in columns
    )
    cpi, cpc, gpt = (f"sum_{c}" for c in columns[-3:])
    return f"""
    SELECT *, {cpi} + {cpc} AS marketing_cost, {gpt} - ({cpi} + {cpc}) AS marketing_contribution,
           {gpt} / nullif({cpi} + {cpc}, 0) AS "ROAS"
    FROM (SELECT {key}, {sums} FROM {table} GROUP BY {key}) q
    """


PARTS["t_chan"] = contribution(
    "t_cost", "channel", ["impression", "click", "conversion", "cpi", "cpc", "gpt"], {"impression", "click", "conversion"}
)
RESULTS["channel_contribution"] = f"""
SELECT channel, sum_impression, sum_click, sum_conversion,
       {r("sum_cpi", "sum_cpc", "sum_gpt", "marketing_cost", "marketing_contribution", '"ROAS"')} FROM t_chan
"""

# --- Journeys and rule-based attribution

PARTS["t_order"] = "SELECT *, dense_rank() OVER (PARTITION BY uid ORDER BY time) AS visit_order FROM t_ev"
PARTS["t_journey"] = """
SELECT uid, 0 AS part,
       concat('Start > ', string_agg(channel, ' > ' ORDER BY time, event_id),
              CASE WHEN last(conversion ORDER BY time, event_id) = 1 THEN ' > Conversion' ELSE ' > Null' END) AS path,
       first(channel ORDER BY time, event_id) AS first_interaction,
       last(channel ORDER BY time, event_id) AS last_interaction,
       last(conversion ORDER BY time, event_id) AS conversion,
       string_agg(cast(visit_order AS varchar), ',' ORDER BY time, event_id) AS visiting_order,
       count(*) AS n_events
FROM t_order GROUP BY uid
"""
_journey = "SELECT uid, part, path, first_interaction, last_interaction, conversion, visiting_order FROM t_journey"
RESULTS["user_journey"] = _journey
RESULTS["upsert"] = _journey
RESULTS["clustered_write"] = (
    "SELECT uid, first_interaction, last_interaction, conversion, n_events FROM t_journey"
)
PARTS["t_won"] = "SELECT * FROM t_journey WHERE conversion = 1"
PARTS["t_touch"] = """
SELECT 'first_touch' AS attribution_model, first_interaction AS channel,
       count(*) / (SELECT count(*) FROM t_won)::double AS share FROM t_won GROUP BY first_interaction
UNION ALL
SELECT 'last_touch', last_interaction, count(*) / (SELECT count(*) FROM t_won)::double FROM t_won GROUP BY last_interaction
"""
RESULTS["first_last_touch"] = f"""
SELECT attribution_model, channel, round(share, 2) AS attribution_percent, {r("share")} FROM t_touch
"""

# --- Visit profile, contribution and ranking

PARTS["t_visit"] = """
SELECT DISTINCT uid, time, channel, product_stars,
       count(interaction) OVER (PARTITION BY uid, channel) AS visit_impr,
       cast(sum(click) OVER p AS bigint) AS visit_clicks, cast(sum(conversion) OVER p AS bigint) AS visit_txns,
       max(cpm) OVER p AS max_cpm, avg(cpi) OVER p AS avg_cpi, max(cpc) OVER p AS bid_cpc, avg(gpt) OVER p AS gpt
FROM t_cost WINDOW p AS (PARTITION BY uid, channel, product_stars)
"""
RESULTS["visit_profile"] = f"""
SELECT uid, time, channel, product_stars, visit_impr, visit_clicks, visit_txns,
       {r("max_cpm", "avg_cpi", "bid_cpc", "gpt")} FROM t_visit
"""
_calendar = """cast(month(time) AS int) AS month, cast(dayofweek(time) + 1 AS int) AS dayofweek,
       cast(weekofyear(time) AS int) AS weekofyear, cast(floor(epoch(time)) AS bigint) AS timestamp"""
RESULTS["calendar"] = f"SELECT event_id, time, {_calendar} FROM t_ev"
_bid = ["visit_impr", "visit_clicks", "visit_txns", "avg_cpi", "bid_cpc", "gpt"]
_whole = {"visit_impr", "visit_clicks", "visit_txns"}
_sums = "sum_visit_impr, sum_visit_clicks, sum_visit_txns, " + r(
    "sum_avg_cpi", "sum_bid_cpc", "sum_gpt", "marketing_cost", "marketing_contribution", '"ROAS"'
)
PARTS["t_contrib"] = contribution("t_visit", "uid", _bid, _whole)
PARTS["t_product"] = contribution("t_visit", "product_stars", _bid, _whole)
PARTS["t_channel"] = contribution("t_visit", "channel", _bid, _whole)
RESULTS["customer_contribution"] = f"SELECT uid, {_sums} FROM t_contrib"
RESULTS["product_contribution"] = f"""
SELECT product_stars, {_sums}, cast(dense_rank() OVER (ORDER BY "ROAS" DESC) AS int) AS product_rank FROM t_product
"""
RESULTS["channel_contribution_ranked"] = f"""
SELECT channel, {_sums}, cast(dense_rank() OVER (ORDER BY "ROAS" DESC) AS int) AS channel_rank FROM t_channel
"""
PARTS["t_tile"] = """
SELECT uid, sum_visit_impr, cast(ntile(100) OVER (ORDER BY sum_visit_impr, uid) AS int) AS "VISIT_RANK" FROM t_contrib
"""
PARTS["t_tile2"] = """
SELECT "VISIT_RANK", cast(dense_rank() OVER (ORDER BY sum(sum_visit_impr)) AS int) AS "VISIT_RANK2"
FROM t_tile GROUP BY "VISIT_RANK"
"""
PARTS["t_rank"] = 'SELECT uid, sum_visit_impr, "VISIT_RANK", "VISIT_RANK2" FROM t_tile JOIN t_tile2 USING ("VISIT_RANK")'
RESULTS["visit_rank"] = "SELECT * FROM t_rank"
RESULTS["rank_extremes"] = "SELECT " + ", ".join(
    f'{f}("{c}") AS "{f}_{c}"' for c in ("sum_visit_impr", "VISIT_RANK", "VISIT_RANK2") for f in ("min", "max")
) + " FROM t_rank"
RESULTS["channel_clicks_and_customers"] = """
SELECT channel, sum_visit_clicks, ncust
FROM t_channel JOIN (SELECT channel, count(*) AS ncust FROM t_ev GROUP BY channel) q USING (channel)
"""
RESULTS["click_deciles"] = """
SELECT "CLICKS_RANK", cast(sum(sum_visit_clicks) AS bigint) AS sum_visit_clicks
FROM (SELECT *, cast(ntile(10) OVER (ORDER BY sum_visit_clicks DESC, uid) AS int) AS "CLICKS_RANK" FROM t_contrib) q
GROUP BY "CLICKS_RANK"
"""
PARTS["t_silver"] = f"""
SELECT t_visit.*, {_calendar}, sum_visit_impr, "VISIT_RANK2" FROM t_visit LEFT JOIN t_rank USING (uid)
"""
RESULTS["silver_visits"] = f"""
SELECT uid, time, channel, product_stars, visit_impr, visit_clicks, visit_txns,
       {r("max_cpm", "avg_cpi", "bid_cpc", "gpt")}, month, dayofweek, weekofyear, timestamp, sum_visit_impr, "VISIT_RANK2"
FROM t_silver
"""
PARTS["t_user"] = f"""
SELECT uid, count(interaction) AS user_impr, cast(sum(click) AS bigint) AS user_clicks,
       cast(sum(conversion) AS bigint) AS user_txns, {exact_mean("cpi")} AS user_cpi, max(cpc) AS user_cpc,
       {exact_mean("gpt")} AS user_gpt
FROM t_cost GROUP BY uid
"""
RESULTS["user_totals"] = f"""
SELECT uid, user_impr, user_clicks, user_txns, {r("user_cpi", "user_cpc", "user_gpt")} FROM t_user
"""
RESULTS["segment_revenue"] = f"""
SELECT "VISIT_RANK2", cast(sum(user_impr) AS bigint) AS impr, cast(sum(user_clicks) AS bigint) AS clicks,
       cast(sum(user_txns) AS bigint) AS txns, {half_up(exact_mean("user_cpi"))} AS cpm,
       {half_up(exact_mean("user_cpc"))} AS cpc, {half_up(exact_sum("user_gpt"))} AS potential_gp,
       {half_up(exact_mean("user_gpt"))} AS avg_gpt, {half_up("stddev_samp(user_gpt)")} AS std_gpt
FROM t_user LEFT JOIN t_rank USING (uid) GROUP BY "VISIT_RANK2"
"""
RESULTS["impression_percentiles"] = """
SELECT "VISIT_RANK3", cast(sum(user_impr) AS bigint) AS sum_user_impr,
       min(user_impr) AS min_user_impr, max(user_impr) AS max_user_impr
FROM (SELECT *, cast(ntile(100) OVER (ORDER BY user_impr, uid) AS int) AS "VISIT_RANK3" FROM t_user) q
GROUP BY "VISIT_RANK3"
"""
PARTS["t_summary"] = """
SELECT month, weekofyear, dayofweek, uid, channel, product_stars, cast(sum(visit_impr) AS bigint) AS impr,
       cast(sum(sum_visit_impr) AS bigint) AS total_impr, cast(sum(visit_clicks) AS bigint) AS clicks,
       cast(sum(visit_txns) AS bigint) AS txns, max(max_cpm) AS cpm, avg(bid_cpc) AS cpc, avg(gpt) AS gpt
FROM t_silver GROUP BY month, weekofyear, dayofweek, uid, channel, product_stars
"""
_summary = f"""
SELECT month, weekofyear, dayofweek, uid, channel, product_stars, impr, total_impr, clicks, txns,
       {r("cpm", "cpc", "gpt")} FROM t_summary
"""
RESULTS["silver_summary"] = _summary
RESULTS["daily_user_rollup"] = """
SELECT month, weekofyear, dayofweek, uid, first(channel ORDER BY channel, product_stars) AS channel,
       cast(round(cast(avg(product_stars) AS decimal(38, 12)), 6) AS double) AS avg_product_stars, cast(sum(impr) AS bigint) AS sum_impr,
       first(total_impr ORDER BY channel, product_stars) AS first_total_impr,
       cast(sum(clicks) AS bigint) AS sum_clicks, cast(sum(txns) AS bigint) AS sum_txns,
       cast(round(cast(avg(cpm) AS decimal(38, 12)), 6) AS double) AS avg_cpm, cast(round(cast(avg(cpc) AS decimal(38, 12)), 6) AS double) AS avg_cpc, cast(round(cast(avg(gpt) AS decimal(38, 12)), 6) AS double) AS avg_gpt
FROM t_summary GROUP BY month, weekofyear, dayofweek, uid
"""
RESULTS["quality_checks"] = """
SELECT 'silver_rows' AS check_name, count(*) AS n_rows FROM t_silver
UNION ALL SELECT 'summary_rows', count(*) FROM t_summary
UNION ALL SELECT 'clicks_over_impr', count(*) FROM t_summary WHERE clicks > impr
"""
RESULTS["clicks_over_impressions"] = _summary + " WHERE clicks > impr"
_split = draw("uid, '|split'")
RESULTS["hash_split"] = f"""
SELECT event_id, uid, CASE WHEN {_split} < 0.8::double THEN 'train' ELSE 'val' END AS part FROM t_ev
"""

# --- Markov attribution

PARTS["t_step"] = """
SELECT uid, channel, conversion, lag(channel) OVER w AS previous, lead(channel) OVER w AS following
FROM t_ev WINDOW w AS (PARTITION BY uid ORDER BY time, event_id)
"""
PARTS["t_move"] = """
SELECT uid, coalesce(previous, 'Start') AS start_state, channel AS end_state, 1 AS cnt FROM t_step
UNION ALL
SELECT uid, channel, CASE WHEN conversion = 1 THEN 'Conversion' ELSE 'Null' END, 1 FROM t_step WHERE following IS NULL
"""
PARTS["t_matrix"] = """
SELECT start_state, end_state, n / sum(n) OVER (PARTITION BY start_state)::double AS transition_probability
FROM (SELECT start_state, end_state, sum(cnt) AS n FROM t_move GROUP BY start_state, end_state) q
"""
RESULTS["transitions"] = "SELECT uid, start_state, end_state, cnt FROM t_move"
RESULTS["transition_matrix"] = f"SELECT start_state, end_state, {r('transition_probability')} FROM t_matrix"
RESULTS["matrix_row_sums"] = """
SELECT start_state, round(sum(transition_probability), 2) AS transition_probability_sum FROM t_matrix GROUP BY start_state
"""
RESULTS["matrix_pivot"] = "SELECT start_state, " + ", ".join(
    f"""cast(round(cast(max(CASE WHEN end_state = '{s}' THEN transition_probability END) AS decimal(38, 12)), 6) AS double) AS "{s}" """
    for s in ("Social Network", "Search Engine Marketing", "Google Display Network", "Affiliates", "Email", "Conversion", "Null")
) + " FROM t_matrix GROUP BY start_state"
RESULTS["matrix_stats"] = f"""
SELECT m.start_state, end_state, {r("transition_probability")}, n_edges, {r("avg_trans_prob")}
FROM t_matrix m JOIN (SELECT start_state, count(*) AS n_edges, avg(transition_probability) AS avg_trans_prob
                      FROM t_matrix GROUP BY start_state) a ON a.start_state = m.start_state
"""
RESULTS["end_states"] = "SELECT DISTINCT end_state FROM t_matrix"
RESULTS["staying_stats"] = """
SELECT start_state, cast(round(cast(sum(transition_probability) AS decimal(38, 12)), 6) AS double) AS sum_p, cast(round(cast(avg(transition_probability) AS decimal(38, 12)), 6) AS double) AS avg_p,
       cast(round(cast(stddev_samp(transition_probability) AS decimal(38, 12)), 6) AS double) AS std_p
FROM t_matrix WHERE end_state <> 'Null' AND start_state <> 'Start' GROUP BY start_state
"""
PARTS["t_graph"] = """
SELECT removed, start_state, CASE WHEN end_state = removed THEN 'Null' ELSE end_state END AS end_state, transition_probability
FROM t_matrix CROSS JOIN (SELECT '(none)' AS removed UNION ALL SELECT DISTINCT start_state FROM t_matrix
                          WHERE start_state <> 'Start') c
WHERE start_state <> removed
"""
RESULTS["removal_graph"] = f"SELECT removed, start_state, end_state, {r('transition_probability')} FROM t_graph"
RESULTS["removal_adjacency"] = """
SELECT removed, start_state, string_agg(end_state, ',' ORDER BY end_state) AS next_stages,
       cast(round(cast(sum(transition_probability) AS decimal(38, 12)), 6) AS double) AS total_probability FROM t_graph GROUP BY removed, start_state
"""
PARTS["t_walk"] = """
SELECT DISTINCT removed, 'Start' AS state, ['Start'] AS visited, 1.0::double AS p FROM t_graph
UNION ALL
SELECT w.removed, g.end_state, list_append(w.visited, g.end_state), w.p * g.transition_probability
FROM t_walk w JOIN t_graph g ON g.removed = w.removed AND g.start_state = w.state
WHERE g.end_state <> 'Null' AND NOT list_contains(w.visited, g.end_state)
"""
PARTS["t_prob"] = """
SELECT removed, coalesce(sum(CASE WHEN state = 'Conversion' THEN p END), 0) AS conversion_probability
FROM t_walk GROUP BY removed
"""
PARTS["t_flow"] = """
SELECT 0 AS i, removed, 'Start' AS state, 1.0::double AS p FROM (SELECT DISTINCT removed FROM t_graph) g
UNION ALL
SELECT i + 1, f.removed, g.end_state, sum(f.p * g.transition_probability)
FROM t_flow f JOIN t_graph g ON g.removed = f.removed AND g.start_state = f.state
WHERE i < 200 GROUP BY i, f.removed, g.end_state
"""
PARTS["t_absorb"] = """
SELECT removed, sum(CASE WHEN state = 'Conversion' THEN p ELSE 0 END) AS conversion_probability FROM t_flow GROUP BY removed
"""
RESULTS["conversion_probability"] = f"SELECT removed, {r('conversion_probability')} FROM t_prob"
RESULTS["conversion_probability_absorbing"] = f"SELECT removed, {r('conversion_probability')} FROM t_absorb"


def effect(table: str) -> str:
    base = f"(SELECT conversion_probability FROM {table} WHERE removed = '(none)')"
    return f"""
    SELECT removed AS channel, conversion_probability, round(({base} - conversion_probability) / {base}, 2) AS removal_effect,
           ({base} - conversion_probability) / {base} AS effect
    FROM {table} WHERE removed <> '(none)'
    """


PARTS["t_effect"] = effect("t_prob")
PARTS["t_effect2"] = effect("t_absorb")
RESULTS["removal_effect"] = f"SELECT channel, {r('conversion_probability')}, removal_effect, {r('effect')} FROM t_effect"
RESULTS["removal_effect_absorbing"] = RESULTS["removal_effect"].replace("t_effect", "t_effect2")
PARTS["t_chain"] = """
SELECT 'markov_chain' AS attribution_model, channel,
       round(removal_effect / (SELECT sum(removal_effect) FROM t_effect), 2) AS attribution_percent,
       effect / (SELECT sum(effect) FROM t_effect) AS share
FROM t_effect
"""
RESULTS["markov_attribution"] = f"SELECT attribution_model, channel, attribution_percent, {r('share')} FROM t_chain"
PARTS["t_attr"] = """
SELECT attribution_model, channel, round(share, 2) AS attribution_percent FROM t_touch
UNION ALL SELECT attribution_model, channel, attribution_percent FROM t_chain
"""
RESULTS["attribution_upsert"] = "SELECT * FROM t_attr"

# --- Per-user transitions and risk

_from = "total_state_transitions_initiated_from_start_state"
PARTS["t_um"] = f"""
SELECT *, nstate_trainsitions / {_from}::double AS transition_probability
FROM (SELECT *, cast(sum(nstate_trainsitions) OVER (PARTITION BY uid, start_state) AS bigint) AS {_from}
      FROM (SELECT uid, start_state, end_state, cast(sum(cnt) AS bigint) AS nstate_trainsitions
            FROM t_move GROUP BY uid, start_state, end_state) a) b
"""
PARTS["t_up"] = f"""
SELECT *, start_state_probability * transition_probability AS end_state_probability
FROM (SELECT t_um.*, total_transitions_per_user, {_from} AS nstart_states,
             CASE WHEN end_state = 'Conversion' THEN 1 ELSE 0 END AS conversion,
             {_from} / total_transitions_per_user::double AS start_state_probability
      FROM t_um JOIN (SELECT uid, cast(sum(nstate_trainsitions) AS bigint) AS total_transitions_per_user
                      FROM t_um GROUP BY uid) n USING (uid)) q
"""
RESULTS["user_transition_matrix"] = f"""
SELECT uid, start_state, end_state, nstate_trainsitions, {_from}, {r("transition_probability")} FROM t_um
"""
RESULTS["user_state_probabilities"] = f"""
SELECT uid, start_state, end_state, nstate_trainsitions, {_from}, {r("transition_probability")},
       total_transitions_per_user, nstart_states, conversion, {r("start_state_probability", "end_state_probability")},
       (SELECT count(*) FROM t_um) AS total_nrows
FROM t_up
"""
PARTS["t_exposure"] = f"""
SELECT uid, start_state, {_from}, total_transitions_per_user, start_state_probability,
       cast(sum(conversion) AS bigint) AS conversions, sum(end_state_probability) AS to_browse_prob
FROM t_up WHERE end_state <> 'Null'
GROUP BY uid, start_state, {_from}, total_transitions_per_user, start_state_probability
"""
RESULTS["state_exposure"] = f"""
SELECT uid, start_state, {_from}, total_transitions_per_user, {r("start_state_probability")}, conversions,
       {r("to_browse_prob")} FROM t_exposure
"""
PARTS["t_bbs"] = f"""
SELECT uid, start_state, cast(sum({_from}) AS bigint) AS transitions, sum(to_browse_prob) AS to_browse
FROM t_exposure WHERE start_state <> 'Start' GROUP BY uid, start_state
"""
PARTS["t_browse"] = "SELECT uid, sum(to_browse) AS prob_to_browse FROM t_bbs GROUP BY uid"
RESULTS["browse_by_state"] = f"SELECT uid, start_state, transitions, {r('to_browse')} FROM t_bbs"
RESULTS["browse_probability"] = f"SELECT uid, {r('prob_to_browse')} FROM t_browse"
RESULTS["user_row_sums"] = """
SELECT uid, start_state, cast(round(cast(sum(transition_probability) AS decimal(38, 12)), 6) AS double) AS sum_p FROM t_up GROUP BY uid, start_state
"""
PARTS["t_thresh"] = """
SELECT *, CASE WHEN avg_transitions_per_chanel - std_transitions_per_channel > 0
               THEN avg_transitions_per_chanel - std_transitions_per_channel ELSE 0.0::double END AS thresh_per_channel
FROM (SELECT start_state, avg(total_transitions_per_user) AS avg_transitions_per_chanel,
             stddev_samp(total_transitions_per_user) AS std_transitions_per_channel FROM t_up GROUP BY start_state) q
"""
PARTS["t_score"] = """
SELECT *, total_transitions_per_user / nullif(thresh_per_channel, 0) AS risk_score
FROM (SELECT DISTINCT uid, start_state, total_transitions_per_user FROM t_up WHERE start_state <> 'Start') u
LEFT JOIN t_thresh USING (start_state)
"""
RESULTS["channel_risk_score"] = f"""
SELECT uid, start_state, total_transitions_per_user,
       {r("avg_transitions_per_chanel", "std_transitions_per_channel", "thresh_per_channel", "risk_score")} FROM t_score
"""
PARTS["t_urisk"] = """
SELECT uid, max_transitions, risk_score, "VISIT_RANK2", coalesce(prob_to_browse, 1.0::double) AS prob_to_browse
FROM (SELECT uid, max(total_transitions_per_user) AS max_transitions, max(risk_score) AS risk_score FROM t_score GROUP BY uid) q
LEFT JOIN t_rank USING (uid) LEFT JOIN t_browse USING (uid)
"""
RESULTS["user_risk"] = f"""
SELECT uid, max_transitions, {r("risk_score")}, "VISIT_RANK2", {r("prob_to_browse")} FROM t_urisk
"""
PARTS["t_seg"] = """
SELECT "VISIT_RANK2", cast(sum(max_transitions) AS bigint) AS transitions, avg(risk_score) AS risk_score,
       max(risk_score) AS max_risk_score, stddev_samp(prob_to_browse) AS std_prob,
       100 * stddev_samp(prob_to_browse) * stddev_samp(prob_to_browse) AS std_prob2
FROM t_urisk GROUP BY "VISIT_RANK2"
"""
RESULTS["segment_risk_aversion"] = f"""
SELECT "VISIT_RANK2", transitions, {r("risk_score", "max_risk_score", "std_prob", "std_prob2")} FROM t_seg
"""
RESULTS["user_product_funnel"] = """
SELECT uid, product_stars, cast(sum(impr) AS bigint) AS total_impr, cast(sum(clicks) AS bigint) AS clicks,
       cast(sum(txns) AS bigint) AS txns, cast(round(cast(avg(impr) AS decimal(38, 12)), 6) AS double) AS avg_impr_per_product, cast(round(cast(stddev_pop(impr) AS decimal(38, 12)), 6) AS double) AS std_impr,
       cast(round(cast(sum(clicks) / sum(impr)::double AS decimal(38, 12)), 6) AS double) AS "CTR",
       cast(round(cast(CASE WHEN sum(clicks) > 0 THEN sum(txns) / sum(clicks)::double ELSE sum(txns) / sum(impr)::double END AS decimal(38, 12)), 6) AS double) AS "CVR",
       cast(round(cast(CASE WHEN sum(impr) > 0 THEN sum(txns) / sum(impr)::double ELSE 0 END AS decimal(38, 12)), 6) AS double) AS "CVR2"
FROM (SELECT uid, product_stars, sum(visit_impr) AS impr, sum(visit_clicks) AS clicks, sum(visit_txns) AS txns
      FROM t_silver GROUP BY uid, product_stars) q
GROUP BY uid, product_stars
"""
PARTS["t_ues"] = """
SELECT *, p_end_state * conversions AS p_conversion
FROM (SELECT uid, end_state, sum(end_state_probability) AS p_end_state, cast(sum(conversion) AS bigint) AS conversions
      FROM t_up GROUP BY uid, end_state) q
"""
RESULTS["user_end_states"] = f"SELECT uid, end_state, {r('p_end_state')}, conversions, {r('p_conversion')} FROM t_ues"
RESULTS["end_state_conversion"] = "SELECT end_state, " + ", ".join(
    f"cast(round(cast({f}({c}) AS decimal(38, 12)), 6) AS double) AS {n}_{s}"
    for c, s in (("p_end_state", "p_end"), ("p_conversion", "p_conv"))
    for f, n in (("sum", "sum"), ("avg", "avg"), ("stddev_samp", "std"))
) + " FROM t_ues GROUP BY end_state"
RESULTS["transition_summary"] = """
SELECT start_state, end_state, cast(sum(nstate_trainsitions) AS bigint) AS ntransitions,
       cast(sum(conversion) AS bigint) AS nconversions, cast(round(cast(-avg(transition_probability) AS decimal(38, 12)), 6) AS double) AS avg_transition_prob,
       cast(round(cast(-avg(start_state_probability) AS decimal(38, 12)), 6) AS double) AS avg_start_prob
FROM t_up GROUP BY start_state, end_state
"""
RESULTS["edges_per_user"] = "SELECT uid, count(*) AS cnt FROM t_um GROUP BY uid"
RESULTS["transitions_per_user"] = """
SELECT uid, cast(sum(total_transitions_per_user) AS bigint) AS transitions FROM t_score GROUP BY uid
"""
RESULTS["converting_edges"] = RESULTS["user_transition_matrix"] + " WHERE end_state = 'Conversion'"

# --- Spend reports

PARTS["t_daily"] = "SELECT ud AS campaign_id, channel, sum(value) AS spend FROM t_ev GROUP BY ud, channel"
RESULTS["ad_spend_exploded"] = """
SELECT campaign_id, channel, cast(round(cast(spend / total AS decimal(38, 12)), 6) AS double) AS pct_spend, round(total * (spend / total), 2) AS dollar_spend
FROM t_daily JOIN (SELECT campaign_id, sum(spend) AS total FROM t_daily GROUP BY campaign_id) q USING (campaign_id)
"""
RESULTS["base_conversion_rate"] = """
SELECT count(*) AS count, CASE WHEN conversion = 0 THEN 'Impression' ELSE 'Conversion' END AS interaction_type
FROM t_journey GROUP BY conversion
"""
RESULTS["conversions_by_date"] = """
SELECT count(*) AS count, 'Conversion' AS interaction_type, cast(time AS date) AS date
FROM t_ev WHERE conversion = 1 GROUP BY cast(time AS date)
"""
PARTS["t_conv"] = """
SELECT attribution_model, channel, round(attribution_percent * (SELECT count(*) FROM t_won)) AS conversions_attributed
FROM t_attr
"""
RESULTS["attributed_conversions"] = "SELECT * FROM t_conv"
PARTS["t_spend"] = """
SELECT channel, 0.2::double AS pct_spend, round(10000 * 0.2::double, 2) AS dollar_spend FROM t_cpm
"""
RESULTS["cost_per_acquisition"] = """
SELECT channel, dollar_spend, attribution_model, conversions_attributed,
       round(dollar_spend / nullif(conversions_attributed, 0), 2) AS "CPA_in_Dollars"
FROM t_spend JOIN t_conv USING (channel)
"""
PARTS["t_realloc"] = """
SELECT channel, pct_spend, dollar_spend, attribution_percent, attribution_percent / pct_spend AS "ROAS",
       round(attribution_percent / pct_spend * dollar_spend, 2) AS proposed_dollar_spend
FROM t_spend JOIN t_attr USING (channel) WHERE attribution_model = 'markov_chain'
"""
RESULTS["budget_reallocation"] = """
SELECT channel, pct_spend, dollar_spend, attribution_percent, cast(round(cast("ROAS" AS decimal(38, 12)), 6) AS double) AS "ROAS", proposed_dollar_spend FROM t_realloc
"""
RESULTS["current_and_proposed"] = """
SELECT channel, 'current_spending' AS spending, dollar_spend AS budget FROM t_spend
UNION SELECT channel, 'proposed_spending', proposed_dollar_spend FROM t_realloc
"""

# --- Prediction, scoring and optimization

PARTS["t_val"] = f"""
SELECT *, CASE WHEN visit_impr > 0 THEN visit_clicks / visit_impr::double ELSE 0 END AS ctr,
       CASE WHEN visit_clicks > 0 THEN visit_txns / visit_clicks::double ELSE 0 END AS cvr
FROM t_silver WHERE {_split} >= 0.8::double
"""
PARTS["t_ranked"] = """
SELECT *, cast(ntile(10) OVER (ORDER BY "VISIT_RANK2", uid, time, channel, product_stars) AS int) AS user_rank FROM t_val
"""
_units = """
SELECT month, weekofyear, user_rank, channel, product_stars, cast(sum(visit_impr) AS bigint) AS impr_pred,
       cast(sum(visit_clicks) AS bigint) AS clicks_pred, cast(sum(visit_txns) AS bigint) AS txns_pred,
       avg(avg_cpi) AS cpi_pred, avg(bid_cpc) AS cpc_pred, avg(gpt) AS gpt_pred, avg(ctr) AS ctr_pred, avg(cvr) AS cvr_pred
FROM t_ranked GROUP BY month, weekofyear, user_rank, channel, product_stars
"""
PARTS["t_unit"] = _units
_preds = "impr_pred, clicks_pred, txns_pred, " + r("cpi_pred", "cpc_pred", "gpt_pred", "ctr_pred", "cvr_pred")
RESULTS["score_bid_units"] = f"SELECT month, weekofyear, user_rank, channel, product_stars, {_preds} FROM t_unit"
PARTS["t_segtile"] = """
SELECT "VISIT_RANK2", cast(ntile(10) OVER (ORDER BY "VISIT_RANK2") AS int) AS user_rank
FROM (SELECT DISTINCT "VISIT_RANK2" FROM t_val) q
"""
PARTS["t_ranked_seg"] = 'SELECT * FROM t_val JOIN t_segtile USING ("VISIT_RANK2")'
PARTS["t_unit_seg"] = _units.replace("t_ranked", "t_ranked_seg")
RESULTS["score_bid_units_by_segment"] = RESULTS["score_bid_units"].replace("t_unit", "t_unit_seg")
PARTS["t_logit"] = """
SELECT "VISIT_RANK2", sum(prob_to_browse) AS logit_to_visit FROM t_browse LEFT JOIN t_rank USING (uid) GROUP BY "VISIT_RANK2"
"""
PARTS["t_vscore"] = """
SELECT *, logit_to_visit / (SELECT avg(logit_to_visit) FROM t_logit) AS prob_visit_score FROM t_logit
"""
RESULTS["visit_scores"] = f'SELECT "VISIT_RANK2", {r("logit_to_visit", "prob_visit_score")} FROM t_vscore'
PARTS["t_seeker"] = """
SELECT user_rank, avg(transitions) AS avg_transitions, stddev_samp(transitions) AS std_transitions,
       max(score) AS max_risk_seeker_sore, avg(score) AS avg_risk_seeker_score
FROM (SELECT *, max_risk_score * prob_visit_score AS score, cast(ntile(10) OVER (ORDER BY "VISIT_RANK2") AS int) AS user_rank
      FROM t_seg LEFT JOIN t_vscore USING ("VISIT_RANK2")) q
GROUP BY user_rank
"""
_seek = r("avg_transitions", "std_transitions", "max_risk_seeker_sore", "avg_risk_seeker_score")
RESULTS["risk_seeker_score"] = f"SELECT user_rank, {_seek} FROM t_seeker"
PARTS["t_kpi"] = """
SELECT *, exp_txns * gpt_pred AS revenue, impr_pred * cpi_pred + exp_clicks * cpc_pred AS spend
FROM (SELECT *, exp_clicks * cvr_pred AS exp_txns
      FROM (SELECT *, impr_pred * ctr_pred AS exp_clicks FROM t_unit LEFT JOIN t_seeker USING (user_rank)) a) b
"""
RESULTS["expected_kpis"] = f"""
SELECT month, weekofyear, user_rank, channel, product_stars, {_preds}, {_seek},
       {r("exp_clicks", "exp_txns", "revenue", "spend")} FROM t_kpi
"""
PARTS["t_const"] = """
SELECT sum(revenue) / sum(impr_pred) AS c1, sum(revenue) / sum(exp_clicks) AS c2, sum(revenue) / sum(exp_txns) AS c3 FROM t_kpi
"""
RESULTS["scale_constants"] = f"SELECT {r('c1', 'c2', 'c3')} FROM t_const"


def allocation(value: str, spend: str = "spend") -> str:
    return f"""
    SELECT *, CASE WHEN x >= 0.5 THEN 1 ELSE 0 END AS opt_result
    FROM (SELECT *, CASE WHEN w IS NULL THEN 0.0::double WHEN w <= 0 OR used <= room THEN 1.0::double WHEN used - w >= room THEN 0.0::double
                         ELSE (room - (used - w)) / w END AS x
          FROM (SELECT *, sum(CASE WHEN w > 0 THEN w ELSE 0 END) OVER (
                            ORDER BY CASE WHEN w > 0 THEN 1 ELSE 0 END, CASE WHEN w > 0 THEN v / w END DESC,
                            month, weekofyear, user_rank, channel, product_stars
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used,
                       -sum(CASE WHEN w <= 0 THEN w ELSE 0 END) OVER () AS room
                FROM (SELECT * REPLACE ({spend} AS spend), {value} AS v, {spend} - revenue / 0.7::double AS w FROM t_kpi) a) b) c
    """


PARTS["t_chosen"] = allocation("revenue")
PARTS["t_chosen_risk"] = allocation(
    "revenue + coalesce(avg_risk_seeker_score, 0) * (SELECT c1 FROM t_const) * coalesce(std_transitions, 0)"
)
RESULTS["allocate_budget"] = f"""
SELECT month, weekofyear, user_rank, channel, product_stars, {r("spend", "revenue", "v", "w", "x")}, opt_result FROM t_chosen
"""
RESULTS["allocate_budget_with_risk"] = RESULTS["allocate_budget"].replace("t_chosen", "t_chosen_risk")
PARTS["t_chosen_known"] = allocation("revenue", "CASE WHEN channel <> 'Affiliates' THEN spend END")
RESULTS["allocate_with_missing_rates"] = RESULTS["allocate_budget"].replace("t_chosen", "t_chosen_known")
RESULTS["allocation_summary"] = """
SELECT channel, opt_result, cast(sum(impr_pred) AS bigint) AS impr, cast(sum(clicks_pred) AS bigint) AS clicks,
       cast(sum(txns_pred) AS bigint) AS txns, cast(round(cast(avg(cpi_pred) AS decimal(38, 12)), 6) AS double) AS cpm, cast(round(cast(avg(cpc_pred) AS decimal(38, 12)), 6) AS double) AS cpc,
       cast(round(cast(avg(gpt_pred) AS decimal(38, 12)), 6) AS double) AS gpt, cast(round(cast(avg(ctr_pred) AS decimal(38, 12)), 6) AS double) AS ctr, cast(round(cast(avg(cvr_pred) AS decimal(38, 12)), 6) AS double) AS cvr
FROM t_chosen GROUP BY channel, opt_result
"""
RESULTS["bronze_scan"] = """
SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM events
WHERE event_type = 'purchase' GROUP BY event_type
"""


# --- Multi-touch and Shapley attribution

PARTS["t_weights"] = """
SELECT uid, channel, 1.0::double / count(*) OVER w AS linear,
       power(2.0::double, (epoch_us(time) - max(epoch_us(time)) OVER w) / 7200000000.0::double) AS weight,
       last_value(conversion) OVER (PARTITION BY uid ORDER BY time, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS won
FROM t_ev WINDOW w AS (PARTITION BY uid)
"""
PARTS["t_credits"] = """
SELECT uid, channel, won, linear, weight / sum(weight) OVER (PARTITION BY uid) AS time_decay FROM t_weights
"""
RESULTS["multi_touch"] = f"""
SELECT attribution_model, channel, {r("conversions")},
       {half_up("conversions / sum(conversions) OVER (PARTITION BY attribution_model)")} AS share
FROM (SELECT 'linear' AS attribution_model, channel, sum(linear) AS conversions FROM t_credits WHERE won = 1 GROUP BY channel
      UNION ALL
      SELECT 'time_decay', channel, sum(time_decay) FROM t_credits WHERE won = 1 GROUP BY channel) q
"""
# Every subset of the channels, and every channel outside it.
PARTS["t_sets"] = """
SELECT mask, count(*) AS journeys, sum(won) AS conversions
FROM (SELECT uid, bit_or(CASE channel WHEN 'Affiliates' THEN 1 WHEN 'Email' THEN 2 WHEN 'Google Display Network' THEN 4
                         WHEN 'Search Engine Marketing' THEN 8 ELSE 16 END) AS mask,
             arg_max(conversion, (time, event_id)) AS won FROM t_ev GROUP BY uid) q GROUP BY mask
"""
PARTS["t_worth"] = """
SELECT s AS part, bit_count(s) AS size, coalesce(sum(conversions), 0)::double AS conversions,
       coalesce(sum(conversions) / nullif(sum(journeys), 0)::double, 0) AS rate
FROM (SELECT unnest(range(32))::int AS s) p LEFT JOIN t_sets ON mask & s = mask GROUP BY s
"""
PARTS["t_shapley"] = """
SELECT channel, sum((b.conversions - a.conversions) * factorial(a.size) * factorial(4 - a.size) / 120.0::double) AS conversions,
       sum((b.rate - a.rate) * factorial(a.size) * factorial(4 - a.size) / 120.0::double) AS rate
FROM t_worth a JOIN (VALUES ('Affiliates', 1), ('Email', 2), ('Google Display Network', 4),
                            ('Search Engine Marketing', 8), ('Social Network', 16)) AS c(channel, own) ON a.part & own = 0
JOIN t_worth b ON b.part = a.part | own GROUP BY channel
"""
RESULTS["shapley_attribution"] = f"""
SELECT attribution_model, channel, {r("credit")},
       {half_up("credit / sum(credit) OVER (PARTITION BY attribution_model)")} AS share
FROM (SELECT 'shapley_conversions' AS attribution_model, channel, conversions AS credit FROM t_shapley
      UNION ALL SELECT 'shapley_rate', channel, rate FROM t_shapley) q
"""

# --- Journeys by pauses

PARTS["t_session"] = """
SELECT *, sum(pause) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS session
FROM (SELECT user_id, ts AS time, event_id, channel, t_ev.conversion,
             CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000
                  THEN 1 ELSE 0 END AS pause
      FROM t_ev JOIN events USING (event_id)) q
"""
RESULTS["session_journeys"] = """
SELECT user_id, cast(session AS bigint) AS session, cast(0 AS int) AS part,
       concat('Start > ', string_agg(channel, ' > ' ORDER BY time, event_id),
              CASE WHEN arg_max(conversion, (time, event_id)) = 1 THEN ' > Conversion' ELSE ' > Null' END) AS path,
       arg_min(channel, (time, event_id)) AS first_interaction, arg_max(channel, (time, event_id)) AS last_interaction,
       arg_max(conversion, (time, event_id)) AS conversion,
       string_agg(cast(visit AS varchar), ',' ORDER BY time, event_id) AS visiting_order
FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id, session ORDER BY time) AS visit FROM t_session) q
GROUP BY user_id, session
"""

# --- Streams with late events, and merges

PARTS["t_arrival"] = """
SELECT t_ev.*, sec, CASE WHEN sec <= cut AND event_id % 10 <> 0 THEN 1 ELSE 2 END AS arrival
FROM (SELECT *, epoch(date_trunc('second', time))::bigint AS sec FROM t_ev) t_ev,
     (SELECT (min(epoch(date_trunc('second', ts))::bigint) + max(epoch(date_trunc('second', ts))::bigint)) // 2 AS cut FROM events) c
"""
RESULTS["hourly_conversions"] = """
SELECT make_timestamp(sec // 3600 * 3600000000) AS window_start, make_timestamp((sec // 3600 + 1) * 3600000000) AS window_end,
       channel, count(*) AS n_events, cast(sum(conversion) AS bigint) AS n_conversions
FROM t_arrival, (SELECT max(sec) FILTER (arrival = 1) - 21600 AS first_mark, max(sec) - 21600 AS last_mark FROM t_arrival) m
WHERE (arrival = 1 OR (sec // 3600 + 1) * 3600 > first_mark) AND (sec // 3600 + 1) * 3600 <= last_mark
GROUP BY sec // 3600, channel
"""
_LATEST = """
SELECT cast(user_id AS varchar) AS uid, arg_max(channel, (date_trunc('second', time), conversion, interaction, channel)) AS channel,
       arg_max(interaction, (date_trunc('second', time), conversion, interaction, channel)) AS interaction,
       arg_max(conversion, (date_trunc('second', time), conversion, interaction, channel)) AS conversion,
       max(date_trunc('second', time)) AS time
FROM (SELECT t_ev.*, events.user_id FROM t_ev JOIN events USING (event_id)) e GROUP BY user_id
"""
RESULTS["stream_upsert"] = RESULTS["bucketed_merge"] = _LATEST
