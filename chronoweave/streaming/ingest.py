"""Structured Streaming: idempotent ingest, keyed state and sessions over unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_id(stream: DataFrame) -> DataFrame:
    return stream.withColumn("doc_id", F.substring(F.sha2("text", 256), 1, 32))


def once(stream: DataFrame, ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each content once. With an event time, ids are forgotten after the watermark; without, never."""
    s = with_id(stream)
    return s.withWatermark(ts, late).dropDuplicatesWithinWatermark(["doc_id"]) if ts else s.dropDuplicates(["doc_id"])


def into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Batches go to sink, which must replace by key so that a repeated batch changes nothing."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, key: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Sessions end after a silence of gap; those older than the watermark are final."""
    s = stream.withWatermark(ts, late).groupBy(*key, F.session_window(ts, gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n")).select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def coverage_counts(stream: DataFrame, ts: str, width: str, slide: str, late: str) -> DataFrame:
    """Sliding counts by type, for watching an ingest."""
    s = stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), "event_type")
    return s.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
