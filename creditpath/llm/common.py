"""Helpers shared by the operators: text as words, bounded broadcasts, written intermediate tables."""

from __future__ import annotations

import json
import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditpath.session import scratch_path

SPACES = r"[\x20\x09-\x0D]+"
# A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(folded)


def words_between(text: Column, separators: str) -> Column:
    """The parts of ``text`` between runs of ``separators``; no words for NULL."""
    return F.coalesce(F.array_remove(F.split(text, separators), ""), F.expr("array()").cast("array<string>"))


def crc_of(key: Column) -> Column:
    """CRC-32 of the key as text."""
    return F.crc32(key.cast("string").cast("binary"))


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and continue from there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a scan of at most ``max_rows + 1`` rows reaches the end of ``df``."""
    return df.limit(max_rows + 1).count() <= max_rows


def hinted(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast when it was counted and is small, else left to a shuffle join."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def literal_array(values: Iterable, element: str) -> Column:
    """A constant array; one text in the plan instead of a node per element."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{element}>")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def sum_at(places: Column, weights: Iterable[float], start: float = 0.0) -> Column:
    """``start`` and the sum of the constant ``weights`` at an array of places (from 0)."""
    known = literal_array(weights, "double")
    return F.aggregate(places, F.lit(start), lambda seen, at: seen + F.get(known, at))
