"""Quality classifier by positive-unlabelled learning.

Trusted documents are the positives, other web text is unlabelled. The share of
positives in the unlabelled text is estimated, and a linear model minimises the
non-negative unbiased risk. Features are expressions of the text alone, so scoring
stays in the JVM; the fit uses a bounded sample of feature rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditpath.llm.common import SPACES, crc_of, words_between

# Most positive and most unlabelled documents of a fit, chosen by a hash of doc_id.
SAMPLE_ROWS = 12_000
HELD_OUT = (3, 1)  # crc32(doc_id) mod 3 = 1 is held out
STEPS, RATE, RIDGE = 800, 0.05, 1e-4
# Characters whose number is a feature.
_COUNTED = {
    "upper": "A-Z",
    "digit": "0-9",
    "symbol": r"#*$%&|<>{}\[\]~^_=+/\\@",
    "shout": "!?",
    "stop": ".,;:",
    "line": r"\n",
}


def _number_of(text: Column, kind: str) -> Column:
    # The others go in long runs, which is faster than a match for each that is counted.
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("double")


def with_features(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """``documents`` with its feature columns, and their names; an empty text has the smallest counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = words_between(F.col("text"), SPACES)
    counted = documents.withColumns(
        {
            "_chars": F.length(text).cast("double"),
            "_words": words,
            **{f"_{name}": _number_of(text, kind) for name, kind in _COUNTED.items()},
        }
    )
    counted = counted.withColumns(
        {"_n": F.size("_words").cast("double"), "_kinds": F.size(F.array_distinct("_words")).cast("double")}
    ).drop("_words")
    chars, n = F.greatest(F.col("_chars"), F.lit(1.0)), F.greatest(F.col("_n"), F.lit(1.0))
    shares = {name: F.col(f"_{name}") / (n if name == "stop" else chars) for name in _COUNTED}
    distinct = F.col("_kinds") / n
    features: dict[str, Column] = {
        "x_words": F.log1p("_n"),
        "x_short": F.exp(-F.col("_n") / 30),
        "x_length": F.least(F.col("_chars") / n, F.lit(30.0)),
        "x_distinct": distinct,
        "x_varied": distinct * F.log1p("_n"),
        "x_few": F.greatest(F.lit(0.0), 0.4 - distinct),
        **{f"x_{name}": F.least(share, F.lit(1.0)) for name, share in shares.items()},
        **{f"x_{name}_root": F.sqrt(F.least(share, F.lit(1.0))) for name, share in shares.items()},
    }
    helpers = ["_chars", "_n", "_kinds", *[f"_{name}" for name in _COUNTED]]
    return counted.withColumns(features).drop(*helpers), list(features)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the scores allow: no set may hold more positives than rows."""
    shares = [
        (np.mean(unlabelled >= t) / max(np.mean(positive >= t), 1e-9))
        for t in np.quantile(positive, np.linspace(0.05, 0.9, 35))
    ]
    return float(np.clip(min(shares), 0.05, 0.95))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(weights: np.ndarray, gradient) -> np.ndarray:
    """Adam with a fixed number of full-batch steps."""
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        g = gradient(weights) + RIDGE * weights
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights = weights - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, float]:
    """The weights (last: intercept) that minimise the non-negative risk, and the class prior.

    risk = prior * loss(positives as 1)
         + max(0, loss(unlabelled as 0) - prior * loss(positives as 0)), with logistic loss
    """
    p = np.column_stack([positive, np.ones(len(positive))])
    u = np.column_stack([unlabelled, np.ones(len(unlabelled))])

    def apart(w):  # positives against unlabelled text, for the prior
        return -(p.T @ _sigmoid(-(p @ w))) / len(p) + (u.T @ _sigmoid(u @ w)) / len(u)

    start = _descend(np.zeros(p.shape[1]), apart)
    prior = class_prior(p @ start, u @ start)

    def risk(w):
        zp, zu = p @ w, u @ w
        as_one = -prior * (p.T @ _sigmoid(-zp)) / len(p)
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        as_zero = (u.T @ _sigmoid(zu)) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        # Below zero the negative part is overfitted; it is driven back up.
        return as_one + as_zero if negative >= 0 else -as_zero

    return _descend(start, risk), prior


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Weights by feature name, and ``intercept``, from documents and labels outside the held-out third."""
    learned = F.pmod(crc_of(F.col("doc_id")), F.lit(HELD_OUT[0])) != HELD_OUT[1]
    order = F.xxhash64("doc_id")

    def some(ids: DataFrame, positive: int) -> DataFrame:
        chosen = ids.where(F.col("doc_id").isNotNull() & learned).select("doc_id").distinct()
        return chosen.orderBy(order, "doc_id").limit(sample_rows).select(
            F.col("doc_id").alias("_id"), F.lit(positive).alias("_positive")
        )

    # At most 2 * sample_rows ids.
    chosen = some(labels.where("quality = 1"), 1).unionByName(some(documents, 0))
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # A doc_id on many rows counts once, so no more than the chosen ids reach the driver.
    rows = rows.groupBy("_id", "_positive").agg(F.min("text").alias("text"))
    rows, names = with_features(rows)
    found = rows.select("_positive", *names).toPandas().sort_values(["_positive", *names], ignore_index=True)
    x, is_positive = found[names].to_numpy(dtype=float), found["_positive"].to_numpy() == 1
    if not is_positive.any() or is_positive.all():
        return dict.fromkeys(names, 0.0) | {"intercept": 0.0}
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1
    z = (x - mean) / spread
    weights, _ = fit_pu(z[is_positive], z[~is_positive])
    scaled = weights[:-1] / spread
    return dict(zip(names, scaled.tolist())) | {"intercept": float(weights[-1] - scaled @ mean)}


def classified(documents: DataFrame, model: dict[str, float]) -> DataFrame:
    """``documents`` with score (0 to 1, also for empty texts) and predicted (1 if score >= 0.5).

    Further columns are kept; columns named score, predicted or as a feature are replaced, those
    named as a helper of the features (``_chars``, ``_words``, ``_n``, ``_kinds``, ``_upper`` ...) dropped.
    """
    scored, names = with_features(documents)
    total = F.lit(model["intercept"])
    for name in names:
        total = total + F.lit(model[name]) * F.col(name)
    score = 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(40.0)), F.lit(-40.0))))
    scored = scored.withColumn("score", score).drop(*names)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_scores(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents`` (doc_id, text).

    ``labels`` has doc_id and quality (1: trusted); rows with a NULL id or label teach
    nothing. With no positive or no unlabelled row every score is 0.5. A NULL text is
    empty, a NULL doc_id is not held out; repeated rows are returned as often.
    """
    model = fit(documents, labels, sample_rows)
    held_out = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(False))
    rows = documents.select("doc_id", held_out.alias("held_out"), "text")
    return classified(rows, model).drop("text")
