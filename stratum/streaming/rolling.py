"""Extension, beyond parity: change counts over a stream of events, with late events dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def churn_stream(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, user_id, churn per window; events(ts timestamp, user_id)."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("churn"))
    return counted.select(F.col("window.start").alias("start"), "user_id", "churn")
