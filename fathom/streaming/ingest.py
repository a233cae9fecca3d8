"""Page texts that arrive as files, ingested batch by batch (the engine's own addition)."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from fathom.plans.engine import Engine


def ingest_stream(engine: Engine, source: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """JSON pages (doc_id, filename, page, text) under ``source`` go into the collection.

    A batch that is run again replaces the same documents, so each page counts once.
    """
    pages = engine.spark.readStream.schema("doc_id string, filename string, page int, text string").json(source)
    writer = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: engine.ingest_pages(batch))
    return (writer.trigger(availableNow=True) if once else writer).start()
