"""Structured Streaming over events and papers. An extension: the survey's operators are batch only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timestamps(events: DataFrame) -> DataFrame:
    """ts without zone becomes a timestamp, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total per window; as a stream, rows later than `late` are dropped."""
    rows = timestamps(events)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, n per session."""
    rows = timestamps(events)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once within the watermark."""
    return timestamps(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def ingest(papers: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch of papers to sink(batch, id), once each; stops when the input is read."""
    return papers.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
