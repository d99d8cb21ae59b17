"""Benchmark decontamination by winnowing.

Both sides are cut into words. Of every run of ``window - gram + 1`` consecutive
word ``gram``s the smallest hash is kept, so two texts that share ``window`` words
share a kept hash. The kept hashes of the documents meet those of the benchmark in
an equality join; each hit is extended to the windows around it, and a window counts
only if its words equal those of a benchmark window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditpath.llm.common import BROADCAST_ROWS, lower_ascii, sha256_hex, small_enough, stash, words_between

WINDOW, GRAM = 10, 5
# Everything but digits, letters a-z and characters beyond ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised_words(text: Column) -> Column:
    return words_between(lower_ascii(text), SEPARATORS)


def _grams(hashes: Column, gram: int) -> Column:
    """A hash of every run of ``gram`` words."""
    last = F.size(hashes) - gram
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(gram)]))
    return F.when(last >= 0, each).otherwise(F.expr("array()").cast("array<bigint>"))


def _winnowed(grams: Column, width: int) -> Column:
    """The smallest hash of every ``width`` consecutive ones, each value once."""
    if width == 1:
        return F.array_distinct(grams)
    last = F.size(grams) - width
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(grams, i + k) for k in range(width)]))
    return F.when(last >= 0, F.array_distinct(each)).otherwise(F.expr("array()").cast("array<bigint>"))


def _windows(words: Column, starts: Column, size: int) -> Column:
    """The text of the windows of ``size`` words at the (zero-based) ``starts``."""
    return F.transform(
        starts,
        lambda s: F.struct(
            s.alias("first"), (s + size).alias("end"), F.array_join(F.slice(words, s + 1, size), " ").alias("window")
        ),
    )


def _with_grams(rows: DataFrame, gram: int) -> DataFrame:
    hashed = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("_grams", _grams(F.col("_hashes"), gram)).drop("_hashes")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(size, window, items): the distinct windows of the items and the sorted ids of their items.

    An item of fewer words than ``window``, but not none, is one window.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        normalised_words(F.col("text")).alias("_words"),
    ).withColumn("size", F.least(F.size("_words"), F.lit(window)))
    items = items.where("size > 0")
    starts = F.sequence(F.lit(0), F.size("_words") - F.col("size"))
    each = F.transform(starts, lambda s: F.array_join(F.slice("_words", s + 1, F.col("size")), " "))
    windows = items.select("item", "size", F.explode(F.array_distinct(each)).alias("window"))
    return windows.groupBy("size", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _located(docs: DataFrame, prints: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """A row for each benchmark fingerprint in a document, and one without (``print`` NULL) per document row."""
    docs = docs.withColumn("_prints", _winnowed(F.col("_grams"), width))
    nothing = F.array(F.lit(None).cast("long"))
    if small_enough(prints, broadcast_rows):
        flagged = F.broadcast(prints.withColumn("_known", F.lit(True)))
        each = docs.withColumn("print", F.explode(F.concat("_prints", nothing))).drop("_prints")
        return each.join(flagged, "print", "left").where("_known OR print IS NULL").drop("_known")
    # Written, because the words are read twice and the optimizer would compute the hashes again for every place.
    docs = stash(docs, "winnowed")
    found = docs.select("doc_id", "_text", F.explode("_prints").alias("print")).join(prints, "print", "left_semi")
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).agg(
        F.collect_set("print").alias("_found")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    none = F.expr("array()").cast("array<bigint>")
    joined = docs.drop("_prints").join(found, same, "left")
    return joined.withColumn("print", F.explode(F.concat(F.coalesce("_found", none), nothing))).drop(
        "_id", "_hash", "_found"
    )


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """What each row of ``documents`` (doc_id, text) shares with ``benchmark`` (item_id, text).

    Returns doc_id, n_words, n_hit (words inside an occurring window), items (sorted ids of
    items with an occurring window) and spans (first and end word of the occurring windows).
    A NULL or empty text has no words; a row that is repeated, id and text, is returned as
    often; a NULL doc_id is an id like any other; a NULL item_id counts as the empty id; an
    empty benchmark hits nothing. Further columns are ignored.
    """
    known = benchmark_windows(benchmark, window)
    # At most one class of short windows for each size below ``window``.
    short = sorted(r["size"] for r in known.where(F.col("size") < window).select("size").distinct().collect())
    docs = documents.select(
        "doc_id",
        F.xxhash64("text").alias("_text"),
        normalised_words(F.col("text")).alias("_words"),
    )
    hits = []
    for size in [window, *short]:
        length = min(gram, size)
        ours = known.where(F.col("size") == size).select("window", "items")
        prints = _with_grams(ours.withColumn("_words", F.split("window", " ")), length)
        prints = prints.select(F.explode(_winnowed(F.col("_grams"), size - length + 1)).alias("print")).distinct()
        found = _located(_with_grams(docs, length), prints, size - length + 1, broadcast_rows)
        places = F.filter(F.sequence(F.lit(0), F.size("_grams") - 1), lambda i: F.get("_grams", i) == F.col("print"))
        around = F.transform(
            places,
            lambda i: F.sequence(
                F.greatest(i - (size - length), F.lit(0)), F.least(i, F.size("_words") - size)
            ),
        )
        fits = (F.size("_words") >= size) & F.col("print").isNotNull()
        starts = F.when(fits, F.array_distinct(F.flatten(around)))
        found = found.select(
            "doc_id",
            "_text",
            F.size("_words").alias("n_words"),
            F.col("print").isNull().alias("_row"),
            F.explode_outer(_windows(F.col("_words"), starts, size)).alias("_at"),
        ).select("doc_id", "_text", "n_words", "_row", "_at.*")
        ours = F.broadcast(ours) if small_enough(ours, broadcast_rows) else ours
        found = found.join(ours, "window", "left").where("_row OR items IS NOT NULL")
        hits.append(found.withColumn("_row", F.col("_row") & F.lit(size == window)))
    every = reduce(DataFrame.unionByName, hits)
    span = F.when(F.col("items").isNotNull(), F.struct("first", "end"))
    per_doc = every.groupBy("doc_id", "_text").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.col("_row").cast("long")).alias("_rows"),
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda seen, s: F.struct(
            (seen["n"] + F.greatest(s["end"] - F.greatest(s["first"], seen["upto"]), F.lit(0))).alias("n"),
            F.greatest(seen["upto"], s["end"]).alias("upto"),
        ),
        lambda seen: seen["n"],
    )
    result = per_doc.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        "items",
        "spans",
        F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_copy"),
    )
    return result.drop("_copy")


def contamination_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(documents, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
