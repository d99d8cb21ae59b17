"""Bronze by date: appended in deliveries, pruned by day, and compacted without moving its readers.

``data/part=<id>/day=<date>`` holds the rows of one delivery and day. ``manifest/version=<n>`` is one
row that names the parts of each day, so readers see a delivery or a compaction whole or not at all.
Two writers at once want the same version, and the second one fails without a trace in the table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

DAY, PART = "day", "part"
# How a day without a date is named in a path.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
FILE_ROWS = 5_000_000
_MANIFEST = "parts map<string, array<string>>, batches map<string, bigint>"


class DatedTable:
    """The table in ``path`` with the given columns and ``day``, the date of the column ``time``."""

    def __init__(self, spark: SparkSession, path: str, columns: StructType, time: str = "time"):
        self.spark, self.path, self.time = spark, path.rstrip("/"), time
        self.columns = StructType([StructField(c.name, c.dataType) for c in columns])

    def create(self) -> None:
        """Make the empty table; an error if there is one."""
        self._publish(0, {}, {})

    def version(self) -> int:
        """The number of the latest version."""
        return self._latest()["version"]

    def read(self) -> DataFrame:
        """All rows; a filter on ``day`` reads the folders of these days only."""
        return self._rows(self._latest()["parts"])

    def append(self, rows: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """Add rows; a ``batch`` of a ``stream`` that is in the table already is left out. Whether anything was done.

        Every task writes the days that it holds: nothing is shuffled, and a day of very many rows is no single task.
        """
        latest = self._latest()
        if batch is not None and batch <= latest["batches"].get(stream, -1):
            return False
        part, days = self._write(rows.select(*self.columns.names))
        parts = latest["parts"] | {d: [*latest["parts"].get(d, []), part] for d in days}
        self._publish(latest["version"] + 1, parts, latest["batches"] | ({} if batch is None else {stream: batch}))
        return True

    def compact(self, file_rows: int = FILE_ROWS) -> list[str]:
        """Rewrite the days that lie in several parts, in time order with about ``file_rows`` rows a file; these days.

        A file's range is cut anywhere in the order, so a day of very many rows becomes several files. Other
        days keep their files, and readers of the version before keep theirs.
        """
        latest = self._latest()
        several = {d: p for d, p in latest["parts"].items() if len(p) > 1}
        if several:
            rows = self._rows(several)
            files = max(1, math.ceil(rows.count() / file_rows))
            order = [DAY, self.time, *(c for c in self.columns.names if c != self.time)]
            part, _ = self._write(rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop(DAY))
            self._publish(latest["version"] + 1, latest["parts"] | {d: [part] for d in several}, latest["batches"])
        return sorted(several)

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Write rows as a new part; its name and days (at most one per date)."""
        part = uuid.uuid4().hex
        folder = f"{self.path}/data/{PART}={part}"
        rows.withColumn(DAY, F.to_date(self.time)).write.partitionBy(DAY).mode("errorifexists").parquet(folder)
        days = self.spark.read.schema(f"{DAY} date").parquet(folder).select(F.col(DAY).cast("string")).distinct()
        return part, [NO_DAY if r[DAY] is None else r[DAY] for r in days.collect()]

    def _rows(self, parts: dict[str, Iterable[str]]) -> DataFrame:
        whole = StructType([*self.columns, StructField(DAY, DateType())])
        paths = sorted(f"{self.path}/data/{PART}={p}/{DAY}={d}" for d, found in parts.items() for p in found)
        if not paths:
            return self.spark.createDataFrame([], whole)
        reader = self.spark.read.schema(whole.add(PART, "string")).option("basePath", f"{self.path}/data")
        return reader.parquet(*paths).select(*self.columns.names, DAY)

    def _latest(self) -> dict:
        manifests = self.spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{self.path}/manifest")
        last = manifests.agg(F.max("version")).first()[0]
        return manifests.where(F.col("version") == last).first().asDict()

    def _publish(self, version: int, parts: dict[str, list[str]], batches: dict[str, int]) -> None:
        row = self.spark.createDataFrame([(parts, batches)], _MANIFEST).coalesce(1)
        row.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")


def append_batches(table: DatedTable, stream: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; a micro-batch that comes again changes nothing."""

    def apply(rows: DataFrame, batch: int) -> None:
        table.append(rows, stream, batch)

    return apply
