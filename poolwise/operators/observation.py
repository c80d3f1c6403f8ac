"""Cutoff-safe demand observation: what a scheduler could have seen on a regular grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import EPSILON, HOUR, Trace
from .profile import active_at_ticks, active_by_class, class_domain, on_grid
from .slicing import as_of, one_value, pool_capacity


def observation_start(jobs: DataFrame, cutoff: float, step: float, lookback_hours: int) -> Column:
    """First grid point at or after the first arrival (or the lookback) that hits the cutoff."""
    first = one_value(jobs, F.min("submit_time_seconds"))
    earliest = F.greatest(first, F.lit(float(cutoff - lookback_hours * HOUR)))
    steps = F.floor((F.lit(float(cutoff)) - earliest) / float(step) + EPSILON)
    return F.lit(float(cutoff)) - steps * float(step)


def observe_classes(
    jobs: DataFrame, cutoff: float, step: float = 300.0, lookback_hours: int = 672
) -> DataFrame:
    """Outstanding GPUs per class at every observation up to the cutoff."""
    visible = as_of(jobs, cutoff)
    start = observation_start(jobs, cutoff, step, lookback_hours)
    return active_by_class(visible, start, F.lit(float(cutoff)), step)


def bucket_number(time: Column, interval: float = HOUR) -> Column:
    return F.floor(time / float(interval) + EPSILON).cast("long")


def hourly_max(
    observations: DataFrame, keys: Sequence[str], value: str, interval: float = HOUR
) -> DataFrame:
    """Tumbling maximum of the observed value."""
    return observations.groupBy(
        *keys, bucket_number(F.col("sample_time_seconds"), interval).alias("bucket")
    ).agg(F.max(value).alias("gpus"))


def observe_tenants(
    jobs: DataFrame, cutoff: float, step: float = 300.0, service_class: str = "HP"
) -> DataFrame:
    """Active demand of each (pool, tenant) series on a complete regular grid from a step edge."""
    visible = as_of(jobs, cutoff).where(F.col("service_class") == service_class)
    first = one_value(jobs, F.min("submit_time_seconds"))
    start = F.floor(first / float(step)) * float(step)
    return active_at_ticks(visible, ["gpu_model", "tenant_id"], start, F.lit(float(cutoff)), step)


def observe_pools(trace: Trace, cutoff: float, step: float = 300.0) -> DataFrame:
    """HP, Spot and idle GPUs of each pool at every sample."""
    visible = as_of(trace.jobs, cutoff)
    first = one_value(trace.jobs, F.min("submit_time_seconds"))
    start = F.floor(first / float(step)) * float(step)
    end = F.lit(float(cutoff))
    active = active_at_ticks(visible, ["gpu_model", "service_class"], start, end, step)
    of = lambda c: F.sum(F.when(F.col("service_class") == c, F.col("active_gpus")).otherwise(0.0))
    sampled = active.groupBy("gpu_model", "tick").agg(of("HP").alias("hp"), of("Spot").alias("spot"))
    pools = pool_capacity(trace.nodes).select("gpu_model", "capacity_gpus")
    grid = on_grid(pools, start, end, step)
    busy = F.col("hp_gpus") + F.col("spot_gpus")
    return (
        grid.join(sampled, ["gpu_model", "tick"], "left")
        .withColumns(
            {
                "hp_gpus": F.coalesce("hp", F.lit(0.0)),
                "spot_gpus": F.coalesce("spot", F.lit(0.0)),
            }
        )
        .select(
            "gpu_model",
            "tick",
            "sample_time_seconds",
            "capacity_gpus",
            "hp_gpus",
            "spot_gpus",
            F.greatest(F.lit(0.0), F.col("capacity_gpus") - busy).alias("idle_gpus"),
        )
    )


def aligned_hourly_max(
    samples: DataFrame,
    keys: Sequence[str],
    value: str,
    points_per_hour: int,
    stride_points: int,
) -> DataFrame:
    """Hourly maxima at every stride offset, complete hours only.

    Each sample feeds one hour per offset; the offsets are a fixed handful, so the fan-out is too.
    """
    last = one_value(samples, F.max("tick"))
    offsets = F.array(*[F.lit(o) for o in range(0, points_per_hour, stride_points)])
    hour = F.floor((F.col("tick") - F.col("offset")) / points_per_hour).cast("long")
    usable = F.floor((last + 1 - F.col("offset")) / points_per_hour)
    return (
        samples.select(*keys, "tick", value, F.explode(offsets).alias("offset"))
        .where(F.col("tick") >= F.col("offset"))
        .withColumn("hour_index", hour)
        .where(F.col("hour_index") < usable)
        .groupBy(*keys, "offset", "hour_index")
        .agg(F.max(value).alias("hourly_max_gpus"))
    )


def moving_average(
    history: DataFrame, keys: Sequence[str], order: str, value: str, window: int
) -> DataFrame:
    """Centered mean whose ends see the edge value repeated."""
    if window % 2 == 0:
        raise ValueError("window must be odd")
    half = (window - 1) // 2
    by_key = Window.partitionBy(*keys)
    ordered = by_key.orderBy(order)
    position = F.row_number().over(ordered) - 1
    size = F.count(F.lit(1)).over(by_key)
    left = F.greatest(F.lit(0), F.lit(half) - position)
    right = F.greatest(F.lit(0), position + half - (size - 1))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.sum(value).over(ordered.rowsBetween(-half, half))
    padded = inside + left * F.first(value).over(whole) + right * F.last(value).over(whole)
    trend = padded / float(window)
    return history.withColumn("trend", trend).withColumn("cycle", F.col(value) - F.col("trend"))


def feedback_window(
    events: DataFrame, keys: Sequence[str], end: Column, step: float, window_seconds: float
) -> DataFrame:
    """Weighted eviction rate of the run ends in ``[tick - window, tick]`` at every tick.

    ``events`` has an ``event_time_seconds``, a ``weight`` and an ``evicted`` flag. Each event is
    a step up at the first tick that sees it and a step down past the last one.
    """
    e = F.col("event_time_seconds")
    last = F.floor(end / float(step)).cast("long")
    first_tick = F.ceil(e / float(step)).cast("long")
    past_tick = (F.floor(e / float(step)) + int(window_seconds // step) + 1).cast("long")
    bounded = lambda c: F.least(c, last + 1)
    lost = F.when(F.col("evicted"), F.col("weight")).otherwise(0.0)
    deltas = (
        events.select(
            *keys,
            F.inline(
                F.array(
                    F.struct(
                        bounded(first_tick).alias("tick"),
                        F.col("weight").alias("w"),
                        lost.alias("l"),
                    ),
                    F.struct(
                        bounded(past_tick).alias("tick"),
                        (-F.col("weight")).alias("w"),
                        (-lost).alias("l"),
                    ),
                )
            ),
        )
        .groupBy(*keys, "tick")
        .agg(F.sum("w").alias("w"), F.sum("l").alias("l"))
    )
    dense = on_grid(deltas.select(*keys).distinct(), F.lit(0.0), end, step)
    run = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce("w", F.lit(0.0))).over(run)
    evicted = F.sum(F.coalesce("l", F.lit(0.0))).over(run)
    return (
        dense.join(deltas, [*keys, "tick"], "left")
        .select(*keys, "tick", total.alias("event_weight"), evicted.alias("evicted_weight"))
        .withColumn(
            "eviction_rate",
            F.when(F.col("event_weight") > EPSILON, F.col("evicted_weight") / F.col("event_weight")),
        )
    )
