"""Continuous ingest: a stream of documents into an engine, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quernstone.plans.engine import SearchEngine
from quernstone.storage import materialised


def ingest(stream: DataFrame, engine: SearchEngine, checkpoint: str, language: str | None = None, **trigger: object) -> StreamingQuery:
    """Starts a query that adds the stream's documents to the engine.

    A batch that comes again after a failure adds nothing twice if documents have ids of their own:
    those that are there are skipped. trigger: as for `DataStreamWriter.trigger`; available data only by default.
    """

    def add(batch: DataFrame, _: int) -> None:
        engine.insert_batch(materialised(batch), language=language)  # the batch is gone afterwards

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(add)
        .start()
    )
