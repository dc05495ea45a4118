"""Streaming ingestion into a store: every micro-batch of arriving files is one commit.

An extension: the data model has no time, so there is nothing to window. The batch number goes into the commit, so a batch
that is tried again after a failure is not stored twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from molframe.sources.store import Store


def append_stream(
    spark: SparkSession, source: str, schema: T.StructType, store: str, checkpoint: str, stream: str = "default", **trigger
) -> StreamingQuery:
    """Starts a stream of molecule files at ``source`` into the store; ``trigger`` as of ``DataStreamWriter.trigger``."""

    def take(batch: DataFrame, number: int) -> None:
        target = Store.open(batch.sparkSession, store, writable=True)
        if target.streamed(stream) >= number:
            return
        target.append(batch)
        target.flush(stream=(stream, number))

    reader = spark.readStream.schema(schema).parquet(source)
    return reader.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
