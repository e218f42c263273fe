"""Displacement series that arrive as files: windowed means per point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, *, time: str = "ts", late: str = "10 days", width: str = "30 days") -> DataFrame:
    """Mean displacement and count by code, track and window; rows later than ``late`` are dropped by a stream.

    Works alike on a stream and on a table.
    """
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if stream.isStreaming else rows
    return rows.groupBy("code", "track", F.window(time, width)).agg(F.avg("displacement").alias("displacement"), F.count("*").alias("n")).select("code", "track", F.col("window.start").alias("start"), "displacement", "n")
