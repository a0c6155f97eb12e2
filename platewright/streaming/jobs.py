"""Job states as a stream (beyond what the batch queries need)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(job_id, day, status, ts): each job's latest state per day of a stream of
    (job_id, status, ts), state bounded by the watermark. For update or append mode."""
    seen = events.withWatermark("ts", late)
    latest = seen.groupBy("job_id", F.window("ts", "1 day").alias("w")).agg(F.max(F.struct("ts", "status")).alias("m"))
    return latest.select("job_id", F.col("w.start").alias("day"), "m.status", "m.ts")


def state_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, status, n): events of each state per window, late ones within ``late`` included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")
