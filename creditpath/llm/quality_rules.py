"""Quality rules: counts per text, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over
the buckets are counted, one over the trusted documents and one over the whole corpus.
A document's score is the mean over its n-grams of the log ratio of the two, and a
document is kept when its score is not below a fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditpath.llm.common import BROADCAST_ROWS, SPACES, hinted, sum_at, words_between

BUCKETS = 1 << 14
SMOOTHING = 1.0
# Lowest mean log ratio (in nats an n-gram) of a kept document.
THRESHOLD = -0.05
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\f\r"


def _pairs_up(hashes: Column, size: int) -> Column:
    last = F.size(hashes) - size
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(last >= 0, each).otherwise(F.expr("array()").cast("array<bigint>"))


def _with_hashes(documents: DataFrame, *keep: str) -> DataFrame:
    words = words_between(F.col("text"), SPACES)
    return documents.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_hashes"))


def _buckets(hashes: Column, buckets: int) -> Column:
    both = F.concat(hashes, _pairs_up(hashes, 2))
    return F.transform(both, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def fit_log_ratios(
    documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, broadcast_rows: int = BROADCAST_ROWS
) -> list[float]:
    """The log ratio of each bucket: trusted documents (doc_id in ``trusted``) against all of ``documents``.

    Counts cover every row; ``buckets`` numbers come to the driver.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
    marked = documents.select("doc_id", "text").join(
        hinted(ids.withColumn("_trusted", F.lit(1)), broadcast_rows), F.col("doc_id") == F.col("_id"), "left"
    )
    each = _with_hashes(marked, F.coalesce("_trusted", F.lit(0)).alias("_trusted")).select(
        "_trusted", F.explode(_buckets(F.col("_hashes"), buckets)).alias("bucket")
    )
    counted = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_trusted").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for row in counted:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not sum(target):
        return [0.0] * buckets
    all_raw, all_target = sum(raw) + SMOOTHING * buckets, sum(target) + SMOOTHING * buckets
    return [
        math.log((t + SMOOTHING) / all_target) - math.log((r + SMOOTHING) / all_raw) for r, t in zip(raw, target)
    ]


def _repeated_words(triples: Column) -> Column:
    """Words inside a window of three that occurs twice or more; ``triples`` has the sorted (hash, place)s."""
    same = lambda s, j: F.coalesce(F.get(triples, j)["h"] == s["h"], F.lit(False))
    again = F.filter(triples, lambda s, i: same(s, i + 1) | ((i > 0) & same(s, F.greatest(i - 1, F.lit(0)))))
    places = F.sort_array(F.transform(again, lambda s: s["i"]))
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda seen, at: F.struct(
            (seen["n"] + at + 3 - F.greatest(at, seen["upto"])).alias("n"), (at + 3).alias("upto")
        ),
        lambda seen: seen["n"],
    )


def text_counts(documents: DataFrame) -> DataFrame:
    """``documents`` (text and any further columns) with the counts of the rules and the hashes of the words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, _WHITE, "")) > 0)
    counted = documents.withColumns(
        {
            "_hashes": F.transform(words_between(F.col("text"), SPACES), lambda w: F.xxhash64(w)),
            "word_chars": F.length(F.translate(text, _WHITE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_lines": lines,
        }
    )
    counted = counted.withColumns(
        {
            "n_words": F.size("_hashes").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_triples": _pairs_up(F.col("_hashes"), 3),
        }
    )
    placed = F.sort_array(F.transform("_triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("_triples")) < F.size("_triples")
    counted = counted.withColumn("_triples", F.when(some, placed))
    repeated = F.when(F.col("_triples").isNotNull(), _repeated_words(F.col("_triples"))).otherwise(F.lit(0))
    return counted.withColumn("n_repeat_words", repeated.cast("long")).drop("_lines", "_triples")


def quality_rules(
    documents: DataFrame,
    trusted: DataFrame,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The counts, rule result, score and verdict for every row of ``documents`` (doc_id, text).

    ``trusted`` (doc_id) names the documents of the target distribution. A NULL text
    has no words and fails the rules; repeated rows are returned as often; NULL doc_ids
    are never trusted; with no trusted document every score is 0. Further columns are ignored.
    """
    ratios = fit_log_ratios(documents, trusted, buckets, broadcast_rows)
    counted = text_counts(documents.select("doc_id", "text"))
    chosen = _buckets(F.col("_hashes"), buckets)
    total = sum_at(chosen, ratios)
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (total / n_grams).alias("llr"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
