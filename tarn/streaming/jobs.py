"""Structured Streaming jobs; each applies a batch function of the engine to what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators.documents import chunks
from tarn.sources.files import extracted, kind_of
from tarn.sources.store import Store

CHUNKS = "id string, chunk_index int, heading_path string, content string"


def watch_folder(spark: SparkSession, root: str, store: Store, checkpoint: str, splitter: str = "text", once: bool = True) -> StreamingQuery:
    """Chunks of new and rewritten files into the store's table ``chunks``, replacing what the same path had.

    Exactly once by content: a batch that is run again writes the same rows under the same keys.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)

    def take(batch: DataFrame, _: int) -> None:
        rows = batch.select("path", F.col("modificationTime").alias("mtime"), kind_of(F.col("path")).alias("kind"), "content").filter("kind is not null")
        docs = extracted(rows).select(F.col("path").alias("id"), "text")
        store.buckets("chunks", CHUNKS, ["id"]).replace(chunks(docs, splitter), docs)

    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def apply_stream(source: DataFrame, step: Callable[[DataFrame], DataFrame], store: Store, table: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """``step`` of each micro-batch upserted into a table of the store."""

    def take(batch: DataFrame, _: int) -> None:
        store.upsert(table, step(batch), key)

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and type; works on a stream and on a table alike (an extra: the store itself has no event time)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
