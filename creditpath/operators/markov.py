"""Markov-chain attribution on the graph of channel transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from creditpath.fixed_values import CONVERSION, NULL, START
from creditpath.functions import ratio
from creditpath.plans.small import pin, settle

BASE = "(none)"
# Rounds of the walk after which it is written, so that its plan stays short.
PIN_ROUNDS = 8
# The chain has settled when twice as many steps win no state more than this; so many doublings are made at most.
TOLERANCE, MAX_DOUBLINGS = 1e-14, 60


def transition_matrix(transitions: DataFrame) -> DataFrame:
    """Probability of each state following each state."""
    counts = transitions.groupBy("start_state", "end_state").agg(F.sum("cnt").alias("n"))
    total = F.sum("n").over(Window.partitionBy("start_state"))
    return counts.select("start_state", "end_state", ratio(F.col("n"), total).alias("transition_probability"))


def matrix_row_sums(matrix: DataFrame) -> DataFrame:
    """The probabilities leaving each state; every sum must be 1."""
    total = F.round(F.sum("transition_probability"), 2)
    return matrix.groupBy("start_state").agg(total.alias("transition_probability_sum"))


def end_states(matrix: DataFrame) -> DataFrame:
    return matrix.select("end_state").distinct()


def matrix_pivot(matrix: DataFrame, states: list[str] | None = None) -> DataFrame:
    """The matrix with one column per end state."""
    pivot = matrix.groupBy("start_state").pivot("end_state", states)
    return pivot.agg(F.first("transition_probability"))


def matrix_stats(matrix: DataFrame) -> DataFrame:
    """Each edge with the number and mean probability of the edges that leave its start."""
    start = Window.partitionBy("start_state")
    return matrix.withColumns(
        {
            "n_edges": F.count(F.lit(1)).over(start),
            "avg_trans_prob": F.avg("transition_probability").over(start),
        }
    )


def staying_stats(matrix: DataFrame) -> DataFrame:
    """Sum, mean and deviation of the probabilities of channels to go on to any state but Null."""
    inner = matrix.where((F.col("end_state") != NULL) & (F.col("start_state") != START))
    p = "transition_probability"
    return inner.groupBy("start_state").agg(
        F.sum(p).alias("sum_p"), F.avg(p).alias("avg_p"), F.stddev_samp(p).alias("std_p")
    )


def removal_graphs(matrix: DataFrame) -> DataFrame:
    """The matrix once as it is (``removed`` is '(none)') and once without each channel.

    Without a channel, its own steps are gone and steps to it end in Null.
    """
    channels = matrix.where(F.col("start_state") != START).agg(F.collect_set("start_state")).scalar()
    cases = F.explode(F.concat(F.array(F.lit(BASE)), channels))
    edges = matrix.select(cases.alias("removed"), "start_state", "end_state", "transition_probability")
    end = F.when(F.col("end_state") == F.col("removed"), NULL).otherwise(F.col("end_state"))
    return edges.where(F.col("start_state") != F.col("removed")).withColumn("end_state", end)


def adjacency(graphs: DataFrame) -> DataFrame:
    """The next states and their probabilities of each state, in matching order."""
    edge = F.struct("end_state", "transition_probability")
    lists = graphs.groupBy("removed", "start_state").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    return lists.select(
        "removed",
        "start_state",
        F.col("edges.end_state").alias("next_stages"),
        F.col("edges.transition_probability").alias("next_stage_transition_probabilities"),
    )


def conversion_probability(
    graphs: DataFrame, mode: str = "simple_path", max_channels: int | None = None
) -> DataFrame:
    """The probability of reaching Conversion from Start in each graph.

    ``simple_path`` counts a return to a visited state as lost. ``absorbing`` is
    the Markov chain proper, where it is not. On acyclic graphs they agree.
    Simple paths are kept per set of visited states, of which there may be 2**channels;
    ``max_channels`` makes more channels an error (default: no bound).
    """
    if mode == "simple_path":
        return _simple_path(graphs, max_channels)
    if mode == "absorbing":
        return _absorbing(graphs)
    raise ValueError(f"unknown mode {mode!r}")


def _simple_path(graphs: DataFrame, max_channels: int | None) -> DataFrame:
    graphs = settle(graphs)
    rounds = graphs.select("start_state").distinct().count()
    if max_channels is not None and rounds > max_channels + 1:
        raise ValueError(f"{rounds} states have too many simple paths; use mode='absorbing'")
    moves = graphs.where(F.col("end_state") != NULL).select(
        "removed", F.col("start_state").alias("state"), "end_state", "transition_probability"
    )
    goal = F.col("end_state") == CONVERSION
    walks = graphs.select("removed").distinct().select(
        "removed",
        F.lit(START).alias("state"),
        F.array(F.lit(START)).alias("visited"),
        F.lit(1.0).alias("p"),
        F.lit(0.0).alias("won"),
    )
    for at in range(1, rounds + 1):
        # What has been won stays in a row of its own, whose state has no moves.
        steps = walks.join(moves, ["removed", "state"], "left")
        steps = steps.where(goal | F.col("end_state").isNull() | ~F.array_contains("visited", F.col("end_state")))
        gain = F.col("p") * F.col("transition_probability")
        open_ = F.col("end_state").isNotNull() & ~goal
        walks = (
            steps.select(
                "removed",
                F.when(open_, F.col("end_state")).otherwise(CONVERSION).alias("state"),
                F.when(open_, F.array_sort(F.array_append("visited", F.col("end_state"))))
                .otherwise(F.array(F.lit(CONVERSION)))
                .alias("visited"),
                F.when(open_, gain).otherwise(0.0).alias("p"),
                F.when(goal, gain).otherwise(F.col("won")).alias("won"),
            )
            .groupBy("removed", "state", "visited")
            .agg(F.sum("p").alias("p"), F.sum("won").alias("won"))
        )
        walks = pin(walks) if at % PIN_ROUNDS == 0 else walks
    return walks.groupBy("removed").agg(F.sum("won").alias("conversion_probability"))


def _absorbing(graphs: DataFrame) -> DataFrame:
    """The chain after 1, 2, 4, ... steps, by joining its matrix with itself, until no state wins more.

    Conversion leads to itself, so the column of Conversion is what has been won so far.
    """
    graphs = pin(graphs)
    every = graphs.select("removed").distinct()
    kept = graphs.where(F.col("end_state") != NULL).groupBy("removed", "start_state", "end_state")
    kept = kept.agg(F.sum("transition_probability").alias("p"))
    stay = every.select("removed", F.lit(CONVERSION).alias("start_state"), F.lit(CONVERSION).alias("end_state"), F.lit(1.0).alias("p"))
    chain = pin(kept.unionByName(stay))
    for _ in range(MAX_DOUBLINGS):
        onward = chain.toDF("removed", "end_state", "next_state", "q")
        ways = chain.join(onward, ["removed", "end_state"])
        won = F.when((F.col("end_state") != CONVERSION) & (F.col("next_state") == CONVERSION), F.col("p") * F.col("q"))
        twice = ways.groupBy("removed", "start_state", "next_state").agg(
            F.sum(F.col("p") * F.col("q")).alias("p"), F.sum(won).alias("gain")
        )
        seen = Observation()
        twice = pin(twice.observe(seen, F.max("gain").alias("gain")))
        chain = twice.select("removed", "start_state", F.col("next_state").alias("end_state"), "p").where("p > 0")
        if (seen.get["gain"] or 0.0) <= TOLERANCE:
            break
    reached = chain.where((F.col("start_state") == START) & (F.col("end_state") == CONVERSION)).select("removed", "p")
    found = every.join(reached, "removed", "left")
    return found.select("removed", F.coalesce("p", F.lit(0.0)).alias("conversion_probability"))


def removal_effect(probabilities: DataFrame) -> DataFrame:
    """The part of the conversion probability lost without each channel."""
    base = probabilities.where(F.col("removed") == BASE).select("conversion_probability").scalar()
    effect = ratio(base - F.col("conversion_probability"), base)
    return probabilities.where(F.col("removed") != BASE).select(
        F.col("removed").alias("channel"),
        "conversion_probability",
        F.round(effect, 2).alias("removal_effect"),
        effect.alias("effect"),
    )


def markov_attribution(effects: DataFrame) -> DataFrame:
    """Removal effects as shares of their sum. Rounded values need not add up to 1; ``share`` does."""
    total = Window.partitionBy(F.lit(1))
    percent = ratio(F.col("removal_effect"), F.sum("removal_effect").over(total))
    return effects.select(
        F.lit("markov_chain").alias("attribution_model"),
        "channel",
        F.round(percent, 2).alias("attribution_percent"),
        ratio(F.col("effect"), F.sum("effect").over(total)).alias("share"),
    )
