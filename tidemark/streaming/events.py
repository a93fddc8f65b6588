"""Structured Streaming by event time: first seen, windows, sessions.  Operators with a state of their own are in `state`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, when: str, keep: str = "30 days") -> DataFrame:
    """The first row of each key, state kept as long as `keep` behind the watermark."""
    return stream.withWatermark(when, keep).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, when: str, by: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, by, n, total over tumbling windows; rows later than `late` are left out."""
    grouped = stream.withWatermark(when, late).groupBy(F.window(when, width), by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, when: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """start, end, by, n of runs of rows no further apart than `gap`."""
    grouped = stream.withWatermark(when, late).groupBy(F.session_window(when, gap), by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def drained(stream: DataFrame, name: str, checkpoint: str, folder: str) -> DataFrame:
    """Everything that is there now, run to the end through the stream and read back from files."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/{name}").option("path", f"{folder}/{name}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")
