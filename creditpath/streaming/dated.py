"""The raw log as a stream into bronze by date."""

from __future__ import annotations

from pyspark.sql import DataFrame

from creditpath.sources.dated import DatedTable, append_batches
from creditpath.sources.raw_log import typed
from creditpath.streaming.ingest import stream_raw


def ingest_dated(
    table: DatedTable, source_dir: str, checkpoint_dir: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Append the files that arrived since the last call, each exactly once, and return the table.

    The number of the last micro-batch is kept with the data under the checkpoint's path, so a batch
    that was written before a failure is left out when it comes again.
    """
    rows = typed(stream_raw(table.spark, source_dir, max_files_per_trigger))
    query = (
        rows.writeStream.foreachBatch(append_batches(table, checkpoint_dir))
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read()
