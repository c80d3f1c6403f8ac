"""Forecasts and quotas at every controller update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import EPSILON, HOUR
from ..functions import normal_quantile, rounded
from ..session import cut_lineage
from .forecast import SeasonalConfig, _clip
from .observation import bucket_number

WEEK_HOURS = 168


def _peaks(samples: DataFrame, value: str, step: float) -> tuple[DataFrame, DataFrame]:
    """Finished hourly maxima, and at each sample the maximum of its hour so far."""
    bucket = bucket_number(F.col("sample_time_seconds"), step)
    inside = (
        Window.partitionBy("bucket")
        .orderBy("sample_time_seconds")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    so_far = samples.select(
        "sample_time_seconds", bucket.alias("bucket"), F.col(value).alias("v")
    ).withColumn("v", F.max("v").over(inside))
    full = so_far.groupBy("bucket").agg(F.max("v").alias("v"))
    return full, so_far


def _history(full: DataFrame, so_far: DataFrame, times: DataFrame, key: str, hours: int) -> DataFrame:
    """Per time, the newest ``hours`` hourly maxima with the current hour cut at that time."""
    back = F.explode(F.sequence(F.col("_b") - hours + 1, F.col("_b") - 1))
    at = times.withColumn("_b", bucket_number(F.col(key)))
    older = (
        at.select(key, back.alias("bucket")).where("bucket >= 0").join(full, "bucket").select(key, "bucket", "v")
    )
    now = at.join(so_far, at[key] == so_far["sample_time_seconds"]).select(key, "bucket", "v")
    return older.unionByName(now)


def steady(value: Column) -> Column:
    """Rounded to 6 after 10 digits, so that the noise of a sum's order does not decide a half."""
    return rounded(F.round(value, 10))


def update_forecasts(
    samples: DataFrame,
    value: str,
    start: float,
    capacity: Column,
    config: SeasonalConfig = SeasonalConfig(),
) -> DataFrame:
    """The seasonal forecast at every observation, refitted at its daily retraining instants.

    The work is one row per (update, recent hour) and per (refit, lookback hour): it follows the
    time grid, not the number of jobs.
    """
    step = float(config.aggregation_interval_seconds)
    retrain = float(config.retrain_interval_seconds)
    full, so_far = (cut_lineage(p) for p in _peaks(samples, value, step))
    updates = so_far.select(F.col("sample_time_seconds").alias("cutoff")).withColumn(
        "fitted_at",
        F.lit(start) + F.floor((F.col("cutoff") - start) / retrain + EPSILON) * retrain,
    )
    fits = updates.select("fitted_at").distinct()
    fit = _history(full, so_far, fits, "fitted_at", config.lookback_hours)
    by_fit = Window.partitionBy("fitted_at")
    day = Window.partitionBy("fitted_at", F.col("bucket") % 24)
    week = Window.partitionBy("fitted_at", F.col("bucket") % WEEK_HOURS)
    fit = fit.withColumns(
        {
            "overall": F.avg("v").over(by_fit),
            "day_mean": F.avg("v").over(day),
            "week_mean": F.when(F.count("v").over(week) >= 2, F.avg("v").over(week)),
            "age": F.row_number().over(by_fit.orderBy(F.col("bucket").desc())),
        }
    ).withColumn("expected", F.coalesce("week_mean", "day_mean", "overall"))
    age = F.col("age")
    shape = fit.groupBy("fitted_at").agg(
        F.stddev_pop(F.col("v") - F.col("expected")).alias("sd"),
        F.avg(F.when(age <= 24, F.col("v"))).alias("recent"),
        F.avg(F.when(age.between(25, 48), F.col("v"))).alias("previous"),
        F.first("overall").alias("overall"),
    )
    days = fit.groupBy("fitted_at", (F.col("bucket") % 24).alias("hod")).agg(F.first("day_mean").alias("day_mean"))
    weeks = fit.groupBy("fitted_at", (F.col("bucket") % WEEK_HOURS).alias("how")).agg(
        F.first("week_mean").alias("week_mean")
    )
    hours = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WEEK_HOURS - 1).cast("long")))
    table = (
        shape.select("fitted_at", "overall", hours.alias("how"))
        .withColumn("hod", F.col("how") % 24)
        .join(days, ["fitted_at", "hod"], "left")
        .join(weeks, ["fitted_at", "how"], "left")
        .select("fitted_at", "how", F.coalesce("week_mean", "day_mean", "overall").alias("expected"))
    )
    table = cut_lineage(table)
    levels = (
        _history(full, so_far, updates.select("cutoff"), "cutoff", 24)
        .join(updates, "cutoff")
        .withColumn("how", F.col("bucket") % WEEK_HOURS)
        .join(table, ["fitted_at", "how"])
        .groupBy("cutoff", "fitted_at")
        .agg(F.avg(F.col("v") - F.col("expected")).alias("level"))
    )
    limit = F.greatest(F.lit(1.0), capacity * 0.05)
    drift = F.coalesce((F.col("recent") - F.col("previous")) / 24.0, F.lit(0.0))
    trend = F.greatest(-limit, F.least(limit, drift))
    steps = F.explode(F.sequence(F.lit(1), F.lit(config.forecast_horizon_hours)))
    target = F.col("cutoff") + F.col("horizon_step") * step
    mu = _clip(F.col("expected") + F.col("level") + trend * F.col("horizon_step"), 0.0, capacity)
    z = normal_quantile(config.guarantee_probability)
    return (
        levels.join(shape, "fitted_at")
        .select("*", steps.alias("horizon_step"))
        .withColumn("how", bucket_number(target, step) % WEEK_HOURS)
        .join(table, ["fitted_at", "how"])
        .withColumns(
            {"_mu": mu, "_sigma": F.greatest(F.lit(config.minimum_sigma_gpus), F.col("sd"))}
        )
        .select(
            "cutoff",
            "horizon_step",
            target.alias("target_time_seconds"),
            steady(F.col("_mu")).alias("mu_gpus"),
            steady(F.col("_sigma")).alias("sigma_gpus"),
            steady(_clip(F.col("_mu") + z * F.col("_sigma"), 0.0, capacity)).alias("guarantee_quantile_gpus"),
        )
    )


def update_quotas(
    points: DataFrame, capacity: Column, eta: float, config: SeasonalConfig = SeasonalConfig()
) -> DataFrame:
    """Quota per (update, guarantee horizon): the tightest free capacity up to the horizon."""
    free = F.greatest(F.lit(0.0), capacity - F.col("guarantee_quantile_gpus"))
    wanted = F.array(*[F.lit(h) for h in config.guarantee_horizons_hours])
    return (
        points.withColumn("free", free)
        .select("cutoff", "horizon_step", "free", F.explode(wanted).alias("horizon_hours"))
        .where(F.col("horizon_step") <= F.col("horizon_hours"))
        .groupBy("cutoff", "horizon_hours")
        .agg(F.min("free").alias("free_gpus"))
        .withColumn(
            "spot_quota_gpus",
            _clip(F.floor(F.col("free_gpus") * eta + EPSILON).cast("double"), 0.0, capacity),
        )
    )


def horizon_for(guarantee_seconds: float, horizons=SeasonalConfig.guarantee_horizons_hours) -> int:
    needed = max(1, -(-int(guarantee_seconds) // HOUR))
    for horizon in horizons:
        if horizon >= needed:
            return horizon
    raise ValueError("The guarantee is longer than every declared horizon")
