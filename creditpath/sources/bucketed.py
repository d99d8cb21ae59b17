"""A Parquet table in hash buckets: a merge rewrites only the buckets that hold an updated key.

``data/<id>/bucket=<n>`` holds one version of a bucket. ``manifest/version=<n>`` is one row that
names the folder of each bucket, so readers see a merge whole or not at all: they take the latest
manifest, which is written last, as one file. Two merges at once want the same manifest version,
and the second one fails without a trace in the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from creditpath.plans.small import pin
from creditpath.sources.tables import merged, require_unique

BUCKET = "bucket"
_MANIFEST = "columns string, folders map<int, string>, batches map<string, bigint>"


def newest_rows(rows: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Of each key the row that is largest in ``newest``; ties go by the other columns, so the choice is fixed."""
    rest = [c for c in rows.columns if c not in {*keys, *newest}]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*newest, *rest)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


class BucketedTable:
    """The table in ``path``, with one row per value of ``keys``.

    The number of buckets is fixed when the table is made: choose it so that one bucket is what a task
    can hold. Keys are spread by hash, NULL like any other value.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def create(self, rows: DataFrame) -> None:
        """Write the first version; an error if there is a table."""
        require_unique(rows, self.keys)
        self._publish(0, rows.schema, self._write(rows), {})

    def version(self) -> int:
        """The number of the latest version."""
        return self._latest()["version"]

    def folders(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        return dict(self._latest()["folders"])

    def read(self) -> DataFrame:
        latest = self._latest()
        return self._rows(latest, latest["folders"])

    def merge(self, updates: DataFrame, newest: Sequence[str] = (), stream: str = "", batch: int | None = None) -> bool:
        """Replace rows by key and add new ones; whether anything was done.

        Without ``newest``, an update replaces the row of its key, and two updates of a key are an
        error. With it, the row largest in these columns stays, old or new, in whatever order
        updates arrive. A ``batch`` of a ``stream`` that is in the table already is left out.
        """
        latest = self._latest()
        if batch is not None and batch <= latest["batches"].get(stream, -1):
            return False
        updates = pin(updates.select(*StructType.fromDDL(latest["columns"]).names))
        if newest:
            updates = newest_rows(updates, self.keys, newest)
        else:
            require_unique(updates, self.keys)
        # At most one row per bucket.
        hit = [r[BUCKET] for r in updates.select(self._bucket().alias(BUCKET)).distinct().collect()]
        old = self._rows(latest, {b: f for b, f in latest["folders"].items() if b in hit})
        if newest:
            rows = newest_rows(old.unionByName(updates), self.keys, newest)
        else:
            rows = merged(old, updates, self.keys)
        batches = latest["batches"] | ({} if batch is None else {stream: batch})
        folders = latest["folders"] | (self._write(rows) if hit else {})
        self._publish(latest["version"] + 1, StructType.fromDDL(latest["columns"]), folders, batches)
        return bool(hit)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Write rows to a new folder, one task per bucket; the folder by bucket."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).mode("errorifexists").parquet(folder)
        written = self.spark.read.schema(f"{BUCKET} int").parquet(folder).select(BUCKET).distinct()
        return {r[BUCKET]: folder for r in written.collect()}

    def _rows(self, latest: dict, folders: dict[int, str]) -> DataFrame:
        columns = StructType.fromDDL(latest["columns"])
        if not folders:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*[f"{f}/{BUCKET}={b}" for b, f in sorted(folders.items())])

    def _latest(self) -> dict:
        manifests = self.spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{self.path}/manifest")
        last = manifests.agg(F.max("version")).first()[0]
        return manifests.where(F.col("version") == last).first().asDict()

    def _publish(self, version: int, columns: StructType, folders: dict[int, str], batches: dict[str, int]) -> None:
        columns = StructType([StructField(c.name, c.dataType) for c in columns])
        row = self.spark.createDataFrame([(columns.toDDL(), folders, batches)], _MANIFEST).coalesce(1)
        row.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")
