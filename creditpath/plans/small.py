"""Fixing an intermediate result so that later steps do not recompute it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from creditpath.session import scratch_dir

# A settled result is broadcast in joins only when it was counted and has no more rows than this.
BROADCAST_ROWS = 20_000


def settle(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute ``df`` once, at any size. A result of at most ``max_rows`` rows is marked for a broadcast."""
    pinned, n_rows = pin_counted(df)
    return F.broadcast(pinned) if n_rows <= max_rows else pinned


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def pin_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The pinned rows and their number, counted as they are written."""
    seen = Observation()
    pinned = pin(df.observe(seen, F.count(F.lit(1)).alias("n_rows")))
    return pinned, seen.get["n_rows"]
