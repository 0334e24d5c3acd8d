"""Extension: incremental ingestion and event windows with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.sources.store import Collections


def ingest_stream(spark: SparkSession, folder: str, schema, store: Collections, collection: str, checkpoint: str) -> StreamingQuery:
    """Add every new Parquet file's chunks to a collection, each chunk once, and stop when all are taken.

    A batch that is replayed after a failure adds nothing twice: chunks are identified by their hash.
    """
    stream = spark.readStream.schema(schema).parquet(folder)

    def add(batch: DataFrame, _: int) -> None:
        store.add(collection, batch.filter(F.col("chunk_hash").isNotNull()))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) over tumbling or sliding windows; works on streams, where events later than
    `late` are dropped, and on tables."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = timed.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
