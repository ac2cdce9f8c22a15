"""Streams (M4): the access log as an event stream, and folders read as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sliding_counts(events: DataFrame, length: str = "24 hours", slide: str = "1 hour", lateness: str | None = None, id_col: str = "chunk_id", time_col: str = "accessed_at") -> DataFrame:
    """M4. Accesses per chunk in sliding windows, batch or stream; lateness sets a watermark."""
    events = events.withWatermark(time_col, lateness) if lateness else events
    grouped = events.groupBy(F.window(time_col, length, slide), id_col).agg(F.count("*").alias("accesses"))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), id_col, "accesses")


def session_counts(events: DataFrame, gap: str = "30 minutes", lateness: str | None = None, id_col: str = "chunk_id", time_col: str = "accessed_at") -> DataFrame:
    """Accesses per chunk and session, an extension over the same log."""
    events = events.withWatermark(time_col, lateness) if lateness else events
    grouped = events.groupBy(F.session_window(time_col, gap), id_col).agg(F.count("*").alias("accesses"))
    return grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), id_col, "accesses")


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
