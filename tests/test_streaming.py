"""Windowed demand over a stream equals the batch."""

import random
import tempfile

from pyspark.sql import functions as F

from poolwise.streaming.demand import arrival_pressure, hourly_peaks, with_event_time



def stream_of(spark, frames):
    """One file per micro-batch, in order."""
    root = tempfile.mkdtemp(prefix="poolwise-stream-")
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(root)
    return (
        spark.readStream.schema(frames[0].schema)
        .option("maxFilesPerTrigger", 1)
        .option("latestFirst", "false")
        .parquet(root)
    )


def run_stream(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_windowed_demand(spark):
    rng = random.Random(9)
    rows = [(f"j{i}", rng.uniform(0, 2e5), rng.uniform(60, 9000), float(rng.randint(1, 4)), rng.choice(["HP", "Spot"]), rng.choice("AB")) for i in range(60)]
    jobs = spark.createDataFrame(rows, "job_id string, submit_time_seconds double, duration_seconds double, gpu_count double, service_class string, gpu_model string")
    timed = with_event_time(jobs, "2024-01-01 00:00:00")
    peaks = hourly_peaks(timed.withColumnRenamed("gpu_count", "gpus"))
    batch = {(r.hour_start, r.gpu_model, r.peak_gpus) for r in peaks.collect()}
    sentinel = timed.limit(1).withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 10 DAYS"))
    stream = stream_of(spark, [timed, sentinel, sentinel])
    got = run_stream(hourly_peaks(stream.withColumnRenamed("gpu_count", "gpus")), "peaks")
    assert {(r.hour_start, r.gpu_model, r.peak_gpus) for r in got.collect()} == batch
    assert arrival_pressure(timed).where("job_count > 0").count() > 0
