"""Toxicity classifier: a linear model over character n-grams scaled by naive Bayes log-count ratios.

A text has the n-grams of 3 to 8 characters of its lower-cased form, hashed into 2^20 places; each
place counts once, however often it occurs. Over all labelled rows, Spark counts in how many toxic
and how many other texts each place occurs; its log-count ratio r is

    r = log((toxic + 1/2) / sum of (toxic + 1/2)) - log((other + 1/2) / sum of (other + 1/2))

The model takes the places whose ratio stands out most from chance. A logistic regression is
fitted to a bounded sample of labelled rows, with r in place of 1 for every place present: a
penalty on its weights then holds back most where the counts say least.

Long texts are read in blocks with the overlap of an n-gram, so memory does not grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from creditpath.llm.common import crc_of, hinted, stash

SIZES = (3, 4, 5, 6, 7, 8)  # characters of an n-gram
PLACES = 2**20
# Places in the model: of those whose ratio has at least this size, the ones with the most standard errors.
MIN_RATIO, FEATURES = 1.0, 8_192
# Most toxic and most other documents of the fit, chosen by a hash of doc_id. Counts use all.
SAMPLE_ROWS = 6_000
SMOOTHING = 0.5
STEPS, RATE, RIDGE = 300, 0.05, 2e-4
THRESHOLD = 0.7
HELD_OUT = (3, 1)  # crc32(doc_id) mod 3 = 1 is held out
# Most characters of a text that are hashed at a time.
BLOCK = 500_000
_FACTOR, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _block_places(part: str) -> np.ndarray:
    """The place of every n-gram of ``part``."""
    characters = np.frombuffer(part.encode("utf-32-le"), dtype="<u4")
    characters = np.where(characters < 33, np.uint32(32), characters)
    hashed, found = np.zeros(len(characters), dtype=np.uint32), []
    for size in range(1, min(max(SIZES), len(characters)) + 1):
        hashed = hashed[: len(characters) - size + 1] * _FACTOR + characters[size - 1 :]
        if size in SIZES:
            found.append(((hashed ^ np.uint32(size)) * _MIX) >> np.uint32(12))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def places_of(text: str, keep: np.ndarray | None = None) -> np.ndarray:
    """The distinct places of a text's n-grams; with ``keep`` (feature by place, -1 for none) its distinct features."""
    text = f" {text.lower()} "
    reach, found = max(SIZES) - 1, []
    for start in range(0, len(text), BLOCK):
        # A part goes on with the characters that n-grams from its last place need.
        places = _block_places(text[start : start + BLOCK + reach])
        if keep is not None:
            places = keep[places]
            places = places[places >= 0]
        found.append(_distinct(places))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


_seen_at = np.zeros(PLACES, dtype=np.int32)  # scratch space of one process


def _distinct(places: np.ndarray) -> np.ndarray:
    """The distinct ones of ``places``: each place remembers its last occurrence, and that one stays."""
    if len(places) < 200:
        return np.unique(places)
    numbers = np.arange(len(places), dtype=np.int32)
    _seen_at[places] = numbers
    return places[_seen_at[places] == numbers]


def _texts(batch: pa.RecordBatch) -> list[str]:
    column = batch.column(batch.schema.get_field_index("text")).to_pylist()
    return ["" if text is None else text for text in column]


def place_counts(labelled: DataFrame) -> DataFrame:
    """place, toxic, other: in how many texts of ``labelled`` (text, toxic) each place occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, PLACES), dtype=np.int64)
        for batch in batches:
            toxic = batch.column(batch.schema.get_field_index("toxic")).to_pylist()
            for text, kind in zip(_texts(batch), toxic):
                seen[kind, places_of(text)] += 1
        used = np.flatnonzero(seen.any(axis=0))
        for part in np.array_split(used, max(1, len(used) // 10_000)):
            arrays = [pa.array(part), pa.array(seen[1, part]), pa.array(seen[0, part])]
            yield pa.RecordBatch.from_arrays(arrays, names=["place", "toxic", "other"])

    found = labelled.select("text", "toxic").mapInArrow(count, "place long, toxic long, other long")
    return found.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_count_ratios(counts: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The places in the model and their log-count ratios; at most ``features`` rows reach the driver."""
    p, q = F.col("toxic") + SMOOTHING, F.col("other") + SMOOTHING
    sums = counts.agg(F.sum(p).alias("p"), F.sum(q).alias("q")).first()
    if sums["p"] is None:
        return np.zeros(0, np.int64), np.zeros(0)
    ratio = F.log(p / F.lit(sums["p"])) - F.log(q / F.lit(sums["q"]))
    strength = F.abs(ratio) / F.sqrt(1 / p + 1 / q)
    rated = counts.select("place", ratio.alias("ratio"), strength.alias("strength"))
    best = rated.where(F.abs("ratio") >= MIN_RATIO).orderBy(F.desc("strength"), "place").limit(features).select("place", "ratio").toPandas()
    best = best.sort_values("place")
    return best["place"].to_numpy(dtype=np.int64), best["ratio"].to_numpy(dtype=float)


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray  # times the ratio: what a present place adds
    intercept: float

    def feature_of(self) -> np.ndarray:
        feature = np.full(PLACES, -1, dtype=np.int32)
        feature[self.places] = np.arange(len(self.places))
        return feature


def _logistic(rows, columns, ratio, is_toxic, each) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with a ridge, by Adam over all rows.

    Entry i of the data is ``ratio[columns[i]]`` in row ``rows[i]``; row r counts ``each[r]``.
    """
    n, k = len(is_toxic), len(ratio)
    values = ratio[columns]
    weights, first, second = (np.zeros(k + 1) for _ in range(3))
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, values * weights[columns], n) + weights[k]
        off = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - is_toxic)
        g = np.append(np.bincount(columns, values * off[rows], k) + RIDGE * weights[:k], off.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights = weights - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:k], float(weights[k])


def _held_out(doc_id: str) -> Column:
    return F.coalesce(F.pmod(crc_of(F.col(doc_id)), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model from labelled rows outside the held-out third; None unless both labels occur.

    Counts and log-count ratios use all of these rows, the regression at most ``sample_rows``
    toxic and as many other ones, with equal weight for both sides.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").alias("_id"))
    known = known.agg(F.max("toxic").cast("int").alias("toxic")).where(~_held_out("_id"))
    labelled = documents.select("doc_id", "text").join(hinted(known), F.col("doc_id") == F.col("_id"))
    labelled = stash(labelled.select("doc_id", "text", "toxic"), "labelled")
    if labelled.select("toxic").distinct().count() < 2:
        return None
    places, ratio = log_count_ratios(stash(place_counts(labelled), "place-counts"))
    lookup = Model(places, ratio, 0.0).feature_of()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [places_of(text, lookup) for text in _texts(batch)]
            toxic = batch.column(batch.schema.get_field_index("toxic"))
            yield pa.RecordBatch.from_arrays([toxic, pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    key = F.xxhash64("doc_id", "text")
    parts = []
    for kind in (0, 1):
        rows = labelled.where(F.col("toxic") == kind).withColumn("key", key)
        # The hash up to which rows are taken; only hashes are sorted, and texts stay where they are.
        last = rows.select("key").orderBy("key").limit(sample_rows).agg(F.max("key")).first()[0]
        kept = rows.where(F.col("key") <= last).select("text", "toxic")
        # Equal rows have one hash; the limit leaves out repetitions beyond the number.
        parts.append(kept.mapInArrow(features, "toxic int, found array<int>").limit(sample_rows))
    found = parts[0].unionByName(parts[1]).toPandas()
    found = found.assign(order=[(t, *f) for t, f in zip(found["toxic"], found["found"])]).sort_values("order")
    is_toxic = found["toxic"].to_numpy(dtype=float)
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found["found"]])
    columns = np.concatenate([np.asarray(f, dtype=np.int64) for f in found["found"]])
    weight = np.where(is_toxic == 1, 0.5 / is_toxic.sum(), 0.5 / (1 - is_toxic).sum())
    weights, intercept = _logistic(rows, columns, ratio, is_toxic, weight)
    return Model(places, weights * ratio, intercept)


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and ``score`` of every row of ``documents`` (doc_id, text); 0.5 without a model."""
    ids = documents.schema["doc_id"]
    if model is None:
        return documents.select("doc_id", F.lit(0.5).alias("score"))
    kind = StructType([ids, *StructType.fromDDL("score double")])
    arrow = to_arrow_schema(kind)
    lookup, weights, intercept = model.feature_of(), model.weights, model.intercept

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([weights[places_of(text, lookup)].sum() for text in _texts(batch)]) + intercept
            column = batch.column(batch.schema.get_field_index("doc_id")).cast(arrow[0].type)
            scores = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([column, scores], schema=arrow)

    return documents.select("doc_id", "text").mapInArrow(score, kind)


def toxicity(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.7) for every row of ``documents`` (doc_id, text).

    ``labels`` has doc_id and toxic; rows with a NULL id or a toxic other than 0 and 1 teach nothing,
    a doc_id with both labels is toxic. Without both labels every score is 0.5. A NULL text is
    empty, a NULL doc_id is not held out, repeated rows are returned as often, further columns
    are left out. Labels are joined by a broadcast only when they were counted and are few.
    """
    rows = scored(documents, fit(documents, labels, sample_rows))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return rows.select("doc_id", _held_out("doc_id").alias("held_out"), "score", predicted)
