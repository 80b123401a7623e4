"""Usage logs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_usage(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, calls, failures) in windows of one day; rows later than the watermark are dropped. Batch tables work too."""
    timed = logs.withColumn("created_at", F.col("created_at").cast("timestamp"))  # event time needs an instant
    sums = timed.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("is_success")).alias("failures")
    )
    return sums.select(F.to_date("w.start").alias("day"), "event_type", "calls", "failures")
