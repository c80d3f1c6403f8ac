"""Structured Streaming views of arriving jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import HOUR


def with_event_time(jobs: DataFrame, origin: str) -> DataFrame:
    """Origin-relative seconds as an event time a watermark can follow."""
    micros = F.round(F.col("submit_time_seconds") * 1e6).cast("long")
    base = F.unix_micros(F.lit(origin).cast("timestamp"))
    return jobs.withColumn("event_time", F.timestamp_micros(base + micros))


def hourly_peaks(samples: DataFrame, value: str = "gpus", delay: str = "0 seconds") -> DataFrame:
    """Tumbling hourly maximum per pool of a demand sample stream; late samples are dropped."""
    return (
        samples.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", f"{HOUR} seconds"), "gpu_model")
        .agg(F.max(value).alias("peak_gpus"))
        .select(F.col("window.start").alias("hour_start"), "gpu_model", "peak_gpus")
    )


def arrival_pressure(
    jobs: DataFrame, length: str = "1 hour", every: str = "5 minutes", delay: str = "0 seconds"
) -> DataFrame:
    """Requested GPUs per class over hopping windows of the arrival stream."""
    of = lambda c: F.sum(F.when(F.col("service_class") == c, F.col("gpu_count")).otherwise(0.0))
    return (
        jobs.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", length, every), "gpu_model")
        .agg(
            F.count(F.lit(1)).alias("job_count"),
            of("HP").alias("hp_requested_gpus"),
            of("Spot").alias("spot_requested_gpus"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "gpu_model",
            "job_count",
            "hp_requested_gpus",
            "spot_requested_gpus",
        )
    )
