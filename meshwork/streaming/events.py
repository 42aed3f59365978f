"""Streams of events: windows with watermarks, and temporal edges kept up to date."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """Streams get a watermark, for which times must have a zone (the session's)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def windowed(events: DataFrame, length: str = "1 day", late: str | None = None) -> DataFrame:
    """start, event_type, n, total for a batch or a stream (there with a watermark)."""
    source = _timed(events, late)
    return source.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, n of sessions that end after a gap."""
    source = _timed(events, late)
    return source.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def edge_activity(edges: DataFrame, late: str = "1 day") -> DataFrame:
    """u, bucket, ds: approximate distinct neighbours by day of a stream of (u, v, ts)."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "u").agg(F.approx_count_distinct("v").alias("ds")).select("u", F.col("window.start").alias("bucket"), "ds")
