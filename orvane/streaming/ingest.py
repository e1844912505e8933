"""Continuous ingestion: one revision of a collection for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.collection import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Upsert the rows (id, vector, metadata...) of a stream; of an id that comes twice in a batch, one row counts.

    A batch that is repeated after a failure upserts the same rows again, which
    leaves the view as it is.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(["id"])
        if not batch.isEmpty():
            collection.upsert(batch)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
