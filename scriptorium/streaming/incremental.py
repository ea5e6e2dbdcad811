"""New documents to chunks as they arrive, and counts of events in windows with late data.

The file source's checkpoint does what skip-existing does in batch: each file is processed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import HybridOptions, hybrid_chunks


def stream_table(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def chunk_stream(documents: DataFrame, path: str, checkpoint: str, options: HybridOptions = HybridOptions(), available_now: bool = True, **columns: str) -> StreamingQuery:
    """Writes the chunks of arriving documents as Parquet by chunk type, exactly once."""
    writer = hybrid_chunks(documents, options, **columns).writeStream.format("parquet").partitionBy("chunk_type").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time_col: str = "ts", by: str = "event_type", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, by, events, value): counts and sums in tumbling or sliding windows; events later than ``late`` are dropped by a stream."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    grouped = events.withWatermark(time_col, late).groupBy(span.alias("w"), by)
    return grouped.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), by, "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", time_col: str = "ts", by: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """(by, start, end, events): runs of a user's events with no gap of the given length."""
    grouped = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), by)
    return grouped.agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
