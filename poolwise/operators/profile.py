"""Workload profile: populations, sampled concurrency, daily windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import DAY, HOUR, SERVICE_CLASSES, Trace
from ..functions import exact_quantiles, rounded
from ..session import cut_lineage
from .slicing import one_value, total_capacity

STAT_QUANTILES = {"p50": 0.50, "p95": 0.95}


def class_domain(spark) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in SERVICE_CLASSES])).alias("service_class")
    )


def first_and_last_submit(jobs: DataFrame) -> tuple[Column, Column]:
    row = jobs.agg(
        F.min("submit_time_seconds").alias("s"), F.max("submit_time_seconds").alias("e")
    ).first()
    return F.lit(row.s), F.lit(row.e)


def on_grid(keys: DataFrame, start: Column, end: Column, step: float) -> DataFrame:
    """Every key at the ticks ``start, start + step, ...`` up to ``end``, at least the first one."""
    last = F.greatest(F.lit(0), F.floor((end - start) / float(step))).cast("long")
    return keys.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("tick")
    ).withColumn("sample_time_seconds", start + F.col("tick") * float(step))


def tick_deltas(
    jobs: DataFrame, keys: Sequence[str], start: Column, step: float, last_tick: Column
) -> DataFrame:
    """+gpus at the first tick a job covers and -gpus at the first tick it no longer covers.

    A job is active on ``[submit, submit + duration)``. Deltas are summed per (key, tick) before
    any window sees them, so what is left grows with the time span and not with the jobs.
    """
    finish = F.col("submit_time_seconds") + F.col("duration_seconds")
    first = F.ceil((F.col("submit_time_seconds") - start) / float(step))
    after = F.ceil((finish - start) / float(step))
    bounded = lambda c: F.greatest(F.lit(0), F.least(c, last_tick + 1))
    edges = jobs.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    bounded(first).cast("long").alias("tick"),
                    F.col("gpu_count").alias("delta"),
                    F.lit(1).alias("step"),
                ),
                F.struct(
                    bounded(after).cast("long").alias("tick"),
                    (-F.col("gpu_count")).alias("delta"),
                    F.lit(-1).alias("step"),
                ),
            )
        ),
    )
    return edges.groupBy(*keys, "tick").agg(
        F.sum("delta").alias("delta"), F.sum("step").cast("long").alias("job_delta")
    )


def active_at_ticks(
    jobs: DataFrame, keys: Sequence[str], start: Column, end: Column, step: float
) -> DataFrame:
    """Requested GPUs active at every tick for every key, empty ticks included."""
    last_tick = F.floor((end - start) / float(step)).cast("long")
    deltas = tick_deltas(jobs, keys, start, step, last_tick)
    present = deltas.select(*keys).distinct() if keys else jobs.sparkSession.range(1).select()
    dense = on_grid(present, start, end, step)
    filled = dense.join(deltas, [*keys, "tick"], "left")
    run = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(
        *keys,
        "tick",
        "sample_time_seconds",
        F.sum(F.coalesce("delta", F.lit(0.0))).over(run).alias("active_gpus"),
        F.sum(F.coalesce("job_delta", F.lit(0))).over(run).cast("long").alias("active_jobs"),
    )


def population_by_class(jobs: DataFrame) -> DataFrame:
    totals = jobs.groupBy("service_class").agg(
        F.count(F.lit(1)).alias("job_count"),
        F.sum("gpu_count").alias("requested_gpus"),
        F.sum(F.col("gpu_count") * F.col("duration_seconds") / 3600.0).alias("gpu_hours"),
    )
    return (
        class_domain(jobs.sparkSession)
        .join(totals, "service_class", "left")
        .select(
            "service_class",
            F.coalesce("job_count", F.lit(0)).cast("long").alias("job_count"),
            rounded(F.coalesce("requested_gpus", F.lit(0.0))).alias("requested_gpus"),
            rounded(F.coalesce("gpu_hours", F.lit(0.0))).alias("requested_gpu_hours"),
        )
    )


def summary_stats(
    df: DataFrame, group: Sequence[str], value: str, *, bounded_groups: bool = False
) -> DataFrame:
    """mean / p50 / p95 / max / cv (population), rounded to 6."""
    moments = df.groupBy(*group).agg(
        F.avg(value).alias("_mean"),
        F.max(value).alias("_max"),
        F.stddev_pop(value).alias("_sd"),
    )
    quantiles = exact_quantiles(df, group, value, STAT_QUANTILES, bounded_groups=bounded_groups)
    return moments.join(quantiles, list(group)).select(
        *group,
        rounded(F.col("_mean")).alias("mean"),
        rounded(F.col("p50")).alias("p50"),
        rounded(F.col("p95")).alias("p95"),
        rounded(F.col("_max")).alias("max"),
        F.when(F.col("_mean") != 0, rounded(F.col("_sd") / F.col("_mean"))).alias("cv"),
    )


def report_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The same statistics over tick-level rows, which a time grid already bounds."""
    mean = F.avg(value)
    return df.groupBy(*group).agg(
        rounded(mean).alias("mean"),
        rounded(F.percentile(value, F.lit(0.50))).alias("p50"),
        rounded(F.percentile(value, F.lit(0.95))).alias("p95"),
        rounded(F.max(value)).alias("max"),
        F.when(mean != 0, rounded(F.stddev_pop(value) / mean)).alias("cv"),
    )


def arrival_buckets(jobs: DataFrame, start: Column, end: Column, step: float) -> DataFrame:
    """Requested GPUs arriving per (class, bucket); late arrivals land in the last bucket."""
    last_tick = F.floor((end - start) / float(step)).cast("long")
    arrived = (
        jobs.withColumn(
            "tick",
            F.least(
                F.floor((F.col("submit_time_seconds") - start) / float(step)).cast("long"), last_tick
            ),
        )
        .groupBy("service_class", "tick")
        .agg(F.sum("gpu_count").alias("arrived"))
    )
    dense = on_grid(class_domain(jobs.sparkSession), start, end, step)
    return dense.join(arrived, ["service_class", "tick"], "left").select(
        "service_class",
        "tick",
        F.coalesce("arrived", F.lit(0.0)).alias("arrival_requested_gpus"),
    )


def active_by_class(jobs: DataFrame, start: Column, end: Column, step: float) -> DataFrame:
    """Sampled active demand with both classes always present."""
    dense = on_grid(class_domain(jobs.sparkSession), start, end, step)
    sampled = active_at_ticks(jobs, ["service_class"], start, end, step)
    return dense.join(
        sampled.drop("sample_time_seconds"), ["service_class", "tick"], "left"
    ).select(
        "service_class",
        "tick",
        "sample_time_seconds",
        F.coalesce("active_gpus", F.lit(0.0)).alias("active_gpus"),
        F.coalesce("active_jobs", F.lit(0)).cast("long").alias("active_jobs"),
    )


def workload_stats(jobs: DataFrame, step: float = HOUR) -> DataFrame:
    """Duration, arrival and sampled-active statistics per class."""
    start, end = first_and_last_submit(jobs)
    parts = {
        "duration_seconds": class_domain(jobs.sparkSession).join(
            summary_stats(jobs, ["service_class"], "duration_seconds", bounded_groups=True), "service_class", "left"
        ),
        "arrival_requested_gpus": report_stats(
            arrival_buckets(jobs, start, end, step), ["service_class"], "arrival_requested_gpus"
        ),
        "sampled_active_requested_gpus": report_stats(
            active_by_class(jobs, start, end, step), ["service_class"], "active_gpus"
        ),
    }
    rows = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("measure"), "*")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def regime_signals(trace: Trace, step: float = HOUR) -> DataFrame:
    jobs = trace.jobs
    start, end = first_and_last_submit(jobs)
    capacity = total_capacity(trace.nodes)
    sampled = active_by_class(jobs, start, end, step)
    of = lambda cls, c: F.sum(F.when(F.col("service_class") == cls, F.col(c)).otherwise(0.0))
    peaks = (
        sampled.groupBy("tick")
        .agg(of("HP", "active_gpus").alias("hp"), of("Spot", "active_gpus").alias("spot"))
        .agg(
            F.max("hp").alias("hp_peak"),
            F.max("spot").alias("spot_peak"),
            F.max(F.col("hp") + F.col("spot")).alias("combined_peak"),
        )
    )
    requested = jobs.agg(
        F.coalesce(of("HP", "gpu_count"), F.lit(0.0)).alias("hp"),
        F.coalesce(of("Spot", "gpu_count"), F.lit(0.0)).alias("spot"),
    ).first()
    hp, spot = F.lit(requested.hp), F.lit(requested.spot)
    return peaks.select(
        F.when(hp + spot > 0, rounded(spot / (hp + spot))).alias("spot_requested_gpu_share"),
        rounded(F.col("hp_peak") / capacity).alias("hp_peak_active_pressure"),
        rounded(F.col("spot_peak") / capacity).alias("spot_peak_active_pressure"),
        rounded(F.col("combined_peak") / capacity).alias("combined_peak_active_pressure"),
        F.when(hp == spot, "balanced")
        .when(hp > spot, "HP")
        .otherwise("Spot")
        .alias("dominant_arrival_type"),
    )


def active_sweep(jobs: DataFrame, keys: Sequence[str], step: float, samples: Column) -> DataFrame:
    """Running demand at origin-aligned samples ``0 .. samples - 1``."""
    return active_at_ticks(
        jobs, keys, F.lit(0.0), (samples - 1).cast("double") * float(step), step
    )


def complete_windows(jobs: DataFrame, window: int = DAY) -> Column:
    last = one_value(jobs, F.max("submit_time_seconds"))
    return F.floor((last + 1.0) / float(window)).cast("long")


def daily_windows(
    trace: Trace,
    *,
    window: int = DAY,
    step: int = HOUR,
    min_hp_jobs: int = 20,
    min_spot_jobs: int = 20,
) -> DataFrame:
    """Complete origin-aligned windows with enough of both classes, with their pressure."""
    if window % step:
        raise ValueError("window must be divisible by step")
    per_window = window // step
    submit, gpus = F.col("submit_time_seconds"), F.col("gpu_count")
    tick = lambda t: F.ceil(t / float(step)).cast("long")
    nothing, none = F.lit(0.0), F.lit(0).cast("long")

    def fact(slot: Column, jobs: Column, arrived: Column, delta: Column) -> Column:
        return F.struct(
            slot.alias("slot"), jobs.alias("jobs"), arrived.alias("arrived"), delta.alias("delta")
        )

    # One pass over the jobs: arrivals per window and demand steps per tick, summed at once.
    facts = cut_lineage(
        trace.jobs.select(
            "service_class",
            submit.alias("submit"),
            F.inline(
                F.array(
                    fact(
                        F.floor(submit / float(window)).cast("long") * per_window,
                        F.lit(1).cast("long"), gpus, nothing,
                    ),
                    fact(tick(submit), none, nothing, gpus),
                    fact(tick(submit + F.col("duration_seconds")), none, nothing, -gpus),
                )
            ),
        )
        .groupBy("service_class", "slot")
        .agg(
            F.sum("jobs").alias("jobs"),
            F.sum("arrived").alias("arrived"),
            F.sum("delta").alias("delta"),
            F.max("submit").alias("last_submit"),
        )
    )
    last_submit = one_value(facts, F.max("last_submit"))
    count = F.floor((last_submit + 1.0) / float(window)).cast("long")
    of = lambda cls, v: F.sum(F.when(F.col("service_class") == cls, F.col(v)).otherwise(0))
    index = F.floor(F.col("slot") / per_window).cast("long")
    population = (
        facts.where("jobs > 0")
        .groupBy(index.alias("window_index"))
        .agg(
            of("HP", "jobs").cast("long").alias("hp_job_count"),
            of("Spot", "jobs").cast("long").alias("spot_job_count"),
            of("HP", "arrived").cast("double").alias("hp_requested_gpus"),
            of("Spot", "arrived").cast("double").alias("spot_requested_gpus"),
        )
        .where(F.col("window_index") < count)
        .where((F.col("hp_job_count") >= min_hp_jobs) & (F.col("spot_job_count") >= min_spot_jobs))
    )
    capacity = total_capacity(trace.nodes)
    run = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    ticks = on_grid(
        facts.sparkSession.range(1).select(), nothing, (count * per_window - 1).cast("double"), 1.0
    ).select(F.col("tick").alias("slot"))
    pressure = (
        ticks.join(facts.groupBy("slot").agg(F.sum("delta").alias("delta")), "slot", "left")
        .select("slot", F.sum(F.coalesce("delta", nothing)).over(run).alias("active"))
        .groupBy(index.alias("window_index"))
        .agg(
            rounded(F.max("active") / capacity).alias("combined_peak_active_pressure"),
            rounded(F.avg("active") / capacity).alias("combined_mean_active_pressure"),
        )
    )
    requested = F.col("hp_requested_gpus") + F.col("spot_requested_gpus")
    return population.join(pressure, "window_index").select(
        (F.col("window_index") * float(window)).alias("start_seconds"),
        (F.col("window_index") * float(window) + (window - 1)).alias("end_seconds"),
        "hp_job_count",
        "spot_job_count",
        "hp_requested_gpus",
        "spot_requested_gpus",
        rounded(F.col("spot_requested_gpus") / requested).alias("spot_requested_gpu_share"),
        "combined_peak_active_pressure",
        "combined_mean_active_pressure",
    )


def window_strata(
    windows: DataFrame, pressure_strata: int = 3, spot_share_strata: int = 4
) -> DataFrame:
    """Balanced pressure groups, then balanced Spot-share groups inside each."""
    by_pressure = Window.orderBy("combined_peak_active_pressure", "start_seconds")
    by_share = Window.partitionBy("pressure_stratum").orderBy(
        "spot_requested_gpu_share", "start_seconds"
    )
    return windows.withColumn(
        "pressure_stratum", F.ntile(pressure_strata).over(by_pressure)
    ).withColumn("spot_share_stratum", F.ntile(spot_share_strata).over(by_share))


def stratified_medoids(
    windows: DataFrame, pressure_strata: int = 3, spot_share_strata: int = 4
) -> DataFrame:
    """The window nearest its cell's medians, span-normalised; the earliest wins a tie."""
    cell = Window.partitionBy("pressure_stratum", "spot_share_stratum")

    def normalised(column: str) -> Column:
        value = F.col(column)
        span = F.max(value).over(cell) - F.min(value).over(cell)
        gap = F.abs(value - F.percentile(column, F.lit(0.5)).over(cell))
        return F.when(span != 0, gap / span).otherwise(0.0)

    placed = window_strata(windows, pressure_strata, spot_share_strata)
    scored = placed.withColumn(
        "distance",
        rounded(
            normalised("combined_peak_active_pressure") + normalised("spot_requested_gpu_share"), 9
        ),
    ).withColumn("cell_size", F.count(F.lit(1)).over(cell))
    nearest = cell.orderBy("distance", "start_seconds")
    return scored.withColumn("_rank", F.row_number().over(nearest)).where("_rank = 1").drop("_rank")


def chronological_split(
    windows: DataFrame, calibration_fraction: float, origin_date: str = "2024-01-01"
) -> DataFrame:
    """The first ``floor(n * fraction)`` windows calibrate, the rest evaluate."""
    ordered = Window.orderBy("start_seconds")
    whole = Window.partitionBy()
    cut = F.floor(F.count(F.lit(1)).over(whole) * float(calibration_fraction))
    day = F.date_add(F.lit(origin_date).cast("date"), F.floor(F.col("start_seconds") / DAY).cast("int"))
    return windows.withColumn("date", day.cast("string")).withColumn(
        "partition",
        F.when(F.row_number().over(ordered) <= cut, "calibration").otherwise("evaluation"),
    )
