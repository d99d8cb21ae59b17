"""A stream merged into a bucketed table, each micro-batch once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from creditpath.sources.bucketed import BucketedTable


def stream_upsert(stream: DataFrame, table: BucketedTable, checkpoint_dir: str, newest: Sequence[str]) -> DataFrame:
    """Merge what arrived since the last call into ``table``; of each key the row largest in ``newest`` stays.

    The number of a micro-batch is published together with its rows. If a run stops after that and before
    its checkpoint, the next run brings the batch again and the table leaves it out.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        table.merge(rows, newest, stream=checkpoint_dir, batch=batch)

    query = (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read()
