"""Incremental use: micro-batches through the same idempotent operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from casenet.sources.sinks import append_new


def append_stream(stream: DataFrame, path: str, checkpoint: str, *key: str) -> StreamingQuery:
    """Append each micro-batch's rows whose key ``path`` lacks; a replayed batch adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, *key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
