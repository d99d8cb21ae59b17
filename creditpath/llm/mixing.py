"""Mixing sources to target weights with soft membership.

A classifier learned from a labelled table gives every document the probability of each
domain. Its tokens count towards the domains by these shares. Non-negative rates are
fitted by projected gradients so that the expected tokens of the domains meet their
targets, at the least squared distance from a rate of one.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditpath.llm.common import BROADCAST_ROWS, SPACES, hinted, literal_array, stash, sum_at, words_between

# Buckets of the hashed words, and the count added to each.
BUCKETS, SMOOTHING = 1 << 13, 0.5
# Probabilities are rounded to this step, so documents of equal membership share a cell of the fit.
GRID = 0.01
# Weight of the distance from a rate of one, and the number of projected gradient steps.
PULL, STEPS = 0.001, 8
# Difference of errors and totals at which rates are settled, and most solutions with new zero rates.
TOLERANCE, MAX_SOLVES = 1e-9, 50
# Shares of the tokens in the mixture.
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
MAX_DOMAINS = 8


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table (doc_id, quality, toxic); rows without both labels are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.select("doc_id", domain.alias("domain"))


def _buckets(words: Column, buckets: int) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def fit_domains(
    documents: DataFrame, labelled: DataFrame, domains: list[str], buckets: int = BUCKETS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[list[float], list[list[float]]]:
    """Logarithms of each domain's share and, by domain and bucket, of the words' probabilities.

    Counts cover every labelled document; domains times buckets numbers come to the driver.
    A repeated or contradicting label counts by its least domain.
    """
    wanted = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    wanted = wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.min("domain").alias("_domain"))
    some = documents.select("doc_id", "text").join(hinted(wanted, broadcast_rows), F.col("doc_id") == F.col("_id"))
    # Bucket -1 counts documents.
    each = F.concat(F.array(F.lit(-1)), _buckets(words_between(F.col("text"), SPACES), buckets))
    counted = some.select("_domain", F.explode(each).alias("bucket")).groupBy("_domain", "bucket").count().collect()
    texts = [0.0] * len(domains)
    counts = [[0.0] * buckets for _ in domains]
    for row in counted:
        d = domains.index(row["_domain"])
        if row["bucket"] < 0:
            texts[d] = row["count"]
        else:
            counts[d][row["bucket"]] = row["count"]
    shares = [math.log((n + 1) / (sum(texts) + len(domains))) for n in texts]
    logs = []
    for c in counts:
        total = math.log(sum(c) + SMOOTHING * buckets)
        logs.append([math.log(n + SMOOTHING) - total for n in c])
    return shares, logs


def with_posteriors(documents: DataFrame, shares: list[float], logs: list[list[float]]) -> DataFrame:
    """``documents`` with n_tokens and ``posteriors``, the probability of each domain.

    The log ratios of a text's words are divided by the square root of their number,
    because words of one text are not independent.
    """
    buckets = len(logs[0])
    rows = documents.withColumn("_buckets", _buckets(words_between(F.col("text"), SPACES), buckets))
    rows = rows.withColumn("n_tokens", F.size("_buckets").cast("long"))
    scale = F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))
    # Against the first domain, whose score is its share alone.
    scores = [F.lit(shares[0])]
    for d in range(1, len(logs)):
        total = sum_at(F.col("_buckets"), [a - b for a, b in zip(logs[d], logs[0])])
        scores.append(F.lit(shares[d]) + total / scale)
    rows = rows.withColumn("_scores", F.array(*scores)).drop("_buckets")
    rows = rows.withColumn("_top", F.array_max("_scores"))
    rows = rows.withColumn("_parts", F.transform("_scores", lambda z: F.exp(z - F.col("_top"))))
    total = F.aggregate("_parts", F.lit(0.0), lambda seen, x: seen + x)
    rows = rows.withColumn("_total", total)
    rows = rows.withColumn("posteriors", F.transform("_parts", lambda x: x / F.col("_total")))
    return rows.drop("_scores", "_top", "_parts", "_total")


def _rounded(posteriors: Column, grid: float) -> Column:
    steps = round(1 / grid)
    return F.transform(posteriors, lambda p: F.round(p * steps).cast("int"))


def _after(steps: list[list[float]], cell: Column, grid: float) -> Column:
    """The rate of a cell after some projected steps; each has its pull on every domain and towards one."""

    def step(rate: Column, pulls: Column) -> Column:
        domains = F.slice(pulls, 1, F.size(pulls) - 1)
        down = F.aggregate(F.zip_with(domains, cell, lambda g, p: g * p), F.lit(0.0), lambda a, b: a + b) * F.lit(grid)
        return F.greatest(F.lit(0.0), rate - down - F.element_at(pulls, -1) * (rate - 1))

    return F.aggregate(literal_array(steps, "array<double>"), F.lit(1.0), step) if steps else F.lit(1.0)


def rate_of(errors: list[float], cell: Column, grid: float, pull: float = PULL) -> Column:
    """The rate at which a cell's gradient is zero, given the domains' errors, or zero if that is negative."""
    down = sum((F.lit(e * grid / pull) * F.get(cell, d) for d, e in enumerate(errors)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.lit(1.0) - down)


def fit_rates(
    cells: DataFrame, targets: list[float], grid: float, pull: float = PULL, steps: int = STEPS, tolerance: float = TOLERANCE
) -> tuple[list[float], list[float]]:
    """The domains' errors from which :func:`rate_of` gives each cell's rate, and the totals that the rates meet.

    With w the share of a cell's tokens, p its membership, r its rate and m the share of
    a domain at rates of one, minimises
        sum over domains (sum w p r - target)^2 / m / 2 + pull * sum w (r - 1)^2 / 2
    in the metric of w, in which a projected gradient step of one never overshoots. ``steps`` such
    steps tell which rates are zero. Where they are not, the minimum is linear in the domains'
    errors (total - target) / m: these are solved for, the zero rates are found anew, and so on
    until the errors agree with the totals to ``tolerance``; a warning says when they do not.
    Every step sums over the cells in Spark; a few numbers per domain come to the driver.
    """
    n = len(targets)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return [0.0] * n, [0.0] * n
    weight = F.col("tokens") * F.lit(1.0 / total)
    p = [F.get("cell", d) * F.lit(grid) for d in range(n)]

    def totals(rate: Column) -> np.ndarray:
        return np.array(list(cells.withColumn("rate", rate).agg(*[F.sum(weight * F.col("rate") * x) for x in p]).first()))

    size, wanted = 1.0 / (1.0 + pull), np.array(targets)
    base = totals(F.lit(1.0))
    used, pending, met = base > 0, [], base
    shares = np.where(used, base, 1.0)
    for _ in range(steps):
        errors = np.where(used, (met - wanted) / shares, 0.0)
        pending.append([*(size * errors).tolist(), size * pull])
        met = totals(_after(pending, F.col("cell"), grid))

    def on_face(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Over the cells with a rate above zero: sums of w p and of w p p'."""
        free = cells.withColumn("rate", rate).where("rate > 0")
        pairs = [F.sum(weight * p[i] * p[j]) for i in range(n) for j in range(n)]
        row = [x or 0.0 for x in free.agg(*[F.sum(weight * x) for x in p], *pairs).first()]
        return np.array(row[:n]), np.array(row[n:]).reshape(n, n)

    def solved(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        left = np.diag(shares) + second / pull
        left[~used, :], left[:, ~used] = 0, 0
        left[~used, ~used] = 1
        return np.linalg.solve(left, np.where(used, first - wanted, 0.0))

    errors = solved(*on_face(_after(pending, F.col("cell"), grid)))
    move, off_before = np.zeros(n), np.inf
    for _ in range(MAX_SOLVES):
        first, second = on_face(rate_of(errors.tolist(), F.col("cell"), grid, pull))
        met = first - second @ errors / pull
        off = np.abs(np.where(used, met - wanted - shares * errors, 0.0)).max()
        if off <= tolerance:
            break
        if off > off_before:
            # Too far: back by half.
            move = move / 2
            errors = errors - move
            continue
        off_before, move = off, solved(first, second) - errors
        errors = errors + move
    else:
        warnings.warn(f"rates not settled: totals {met.tolist()} for targets {targets}", stacklevel=2)
    return errors.tolist(), met.tolist()


def mixture(
    documents: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float] = TARGETS,
    columns: Sequence[str] | None = None,
    buckets: int = BUCKETS,
    grid: float = GRID,
    pull: float = PULL,
    steps: int = STEPS,
) -> DataFrame:
    """``documents`` with n_tokens, p_<domain> for each domain, and rate: how often to take the document.

    ``labelled`` has doc_id and domain. ``targets`` are the wanted shares of the tokens
    (scaled to sum to one) of at most ``MAX_DOMAINS`` domains; a domain that no text
    belongs to cannot be met. ``columns`` limits what is returned of ``documents``.
    Every row is returned, also with rate 0; a NULL or empty text has no tokens and the
    rate of its membership, which is that of the labels' shares; a row's rate depends on
    its text alone, so repeated rows have the same. Without labels all domains are
    equally likely. Columns with the names of the results are replaced. An empty table
    stays empty.
    """
    domains = sorted(targets)
    if not 0 < len(domains) <= MAX_DOMAINS or min(targets.values()) < 0 or not sum(targets.values()):
        raise ValueError(f"give one to {MAX_DOMAINS} domains with non-negative shares")
    names = [f"p_{d}" for d in domains]
    taken = {"n_tokens", "rate", "posteriors", *names}
    kept = [c for c in (documents.columns if columns is None else columns) if c not in taken]
    shares, logs = fit_domains(documents, labelled, domains, buckets)
    rows = with_posteriors(documents.select(*dict.fromkeys([*kept, "text"])), shares, logs)
    rows = stash(rows.withColumn("_cell", _rounded(F.col("posteriors"), grid)).select(*kept, "n_tokens", "posteriors", "_cell"), "posteriors")
    cells = stash(rows.groupBy(F.col("_cell").alias("cell")).agg(F.sum("n_tokens").alias("tokens")), "cells")
    share = sum(targets.values())
    errors, _ = fit_rates(cells, [targets[d] / share for d in domains], grid, pull, steps)
    rate = rate_of(errors, F.col("_cell"), grid, pull)
    return rows.select(*kept, "n_tokens", *[F.col("posteriors")[i].alias(name) for i, name in enumerate(names)], rate.alias("rate"))
