"""Protected-demand forecasts, Spot quotas and the feedback that tunes them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import EPSILON, HOUR
from ..functions import exact_quantiles, normal_quantile, rounded
from .observation import bucket_number


@dataclass(frozen=True)
class SeasonalConfig:
    """The declared aggregate controller."""

    observation_interval_seconds: int = 300
    aggregation_interval_seconds: int = HOUR
    lookback_hours: int = 672
    forecast_horizon_hours: int = 4
    retrain_interval_seconds: int = 86400
    guarantee_probability: float = 0.9
    guarantee_horizons_hours: tuple[int, ...] = (1, 2, 4)
    minimum_sigma_gpus: float = 1.0
    initial_eta: float = 1.0
    minimum_eta: float = 0.25
    maximum_eta: float = 1.25
    feedback_window_seconds: int = 14400
    starvation_increase_after_seconds: int = 3600
    high_eviction_ratio: float = 1.5
    low_eviction_ratio: float = 0.5
    eta_increase_step: float = 0.1


@dataclass(frozen=True)
class TenantConfig:
    """The declared tenant controller."""

    demand_sample_interval_seconds: int = 60
    quota_update_interval_seconds: int = 300
    aggregation_interval_seconds: int = HOUR
    lookback_hours: int = 672
    forecast_horizon_hours: int = 4
    validation_hours: int = 168
    training_stride_seconds: int = 300
    guarantee_probability: float = 0.9
    guarantee_horizons_hours: tuple[int, ...] = (1, 2, 4)
    moving_average_window: int = 25
    embedding_dimension: int = 8
    attention_hidden_dimension: int = 16
    train_epochs: int = 10
    batch_size: int = 32
    learning_rate: float = 0.00004
    early_stopping_patience: int = 3
    random_seed: int = 20260807
    initial_eta: float = 1.0
    minimum_eta: float = 0.25
    maximum_eta: float = 1.25
    feedback_window_seconds: int = 14400
    queue_wait_threshold_seconds: int = 3600
    high_eviction_multiple: float = 1.5
    low_eviction_multiple: float = 0.5
    runtime_inventory_cap: bool = True


def _clip(value: Column, low: float, high: Column) -> Column:
    return F.greatest(F.lit(low), F.least(high, value))


def seasonal_forecast(
    observations: DataFrame,
    value: str,
    start: Column,
    cutoff: float,
    capacity: Column,
    config: SeasonalConfig = SeasonalConfig(),
) -> DataFrame:
    """Hour-of-week / hour-of-day Gaussian forecast of the hourly maximum.

    The model is fitted at the last retraining instant before the cutoff and corrected by the
    level of the newest day at the cutoff. Its tables hold one row per hour of the lookback.
    """
    step = float(config.aggregation_interval_seconds)
    retrain = float(config.retrain_interval_seconds)
    span = config.lookback_hours * float(HOUR)
    trained_at = start + F.floor((F.lit(float(cutoff)) - start) / retrain + EPSILON) * retrain
    time, bucket = F.col("sample_time_seconds"), F.col("bucket")
    history = observations.groupBy(bucket_number(time, step).alias("bucket")).agg(
        F.max(F.when(time <= trained_at + EPSILON, F.col(value))).alias("fitted"),
        F.max(value).alias("current"),
        F.max(F.lit(None).cast("long")).alias("horizon_step"),
    )
    targets = observations.sparkSession.range(1, config.forecast_horizon_hours + 1).select(
        bucket_number(F.lit(float(cutoff)) + F.col("id") * step, step).alias("bucket"),
        F.lit(None).cast("double").alias("fitted"),
        F.lit(None).cast("double").alias("current"),
        F.col("id").alias("horizon_step"),
    )
    # From here on there is one row per hour of the lookback plus the targets.
    everything = Window.partitionBy()
    newest = bucket.desc()
    usable = {
        "fit_ok": F.col("fitted").isNotNull() & (bucket * step + EPSILON >= trained_at - span),
        "now_ok": F.col("current").isNotNull() & (bucket * step + EPSILON >= float(cutoff) - span),
    }
    aged = history.unionByName(targets).withColumns(usable)
    aged = aged.withColumns(
        {
            "fit_age": F.row_number().over(Window.partitionBy("fit_ok").orderBy(newest)),
            "now_age": F.row_number().over(Window.partitionBy("now_ok").orderBy(newest)),
        }
    ).withColumn(
        "f",
        F.when(F.col("fit_ok") & (F.col("fit_age") <= config.lookback_hours), F.col("fitted")),
    )
    same_day, same_week = Window.partitionBy(bucket % 24), Window.partitionBy(bucket % 168)
    expected = aged.withColumn(
        "expected",
        F.coalesce(
            F.when(F.count("f").over(same_week) >= 2, F.avg("f").over(same_week)),
            F.avg("f").over(same_day),
            F.avg("f").over(everything),
        ),
    )
    age = F.col("fit_age")
    model = expected.withColumns(
        {
            "sd": F.stddev_pop(F.col("f") - F.col("expected")).over(everything),
            "recent": F.avg(F.when(age <= 24, F.col("f"))).over(everything),
            "previous": F.avg(F.when(age.between(25, 48), F.col("f"))).over(everything),
            "level": F.avg(
                F.when(
                    F.col("now_ok") & (F.col("now_age") <= 24), F.col("current") - F.col("expected")
                )
            ).over(everything),
        }
    ).where(F.col("horizon_step").isNotNull())
    limit = F.greatest(F.lit(1.0), capacity * 0.05)
    drift = F.coalesce((F.col("recent") - F.col("previous")) / 24.0, F.lit(0.0))
    trend = F.greatest(-limit, F.least(limit, drift))
    sigma = F.greatest(F.lit(config.minimum_sigma_gpus), F.col("sd"))
    z = normal_quantile(config.guarantee_probability)
    mu = _clip(F.col("expected") + F.col("level") + trend * F.col("horizon_step"), 0.0, capacity)
    return model.withColumns({"_mu": mu, "_sigma": sigma}).select(
        "horizon_step",
        (F.lit(float(cutoff)) + F.col("horizon_step") * step).alias("target_time_seconds"),
        rounded(F.col("_mu")).alias("mu_gpus"),
        rounded(F.col("_sigma")).alias("sigma_gpus"),
        rounded(_clip(F.col("_mu") + z * F.col("_sigma"), 0.0, capacity)).alias(
            "guarantee_quantile_gpus"
        ),
    )


def _tightest_free(points: DataFrame, keys: Sequence[str], free: Column, horizons) -> DataFrame:
    """Minimum free capacity over the first ``h`` steps for each declared horizon."""
    wanted = F.array(*[F.lit(h) for h in horizons])
    return (
        points.withColumn("_free", free)
        .select(*keys, "horizon_step", "_free", F.explode(wanted).alias("horizon_hours"))
        .where(F.col("horizon_step") <= F.col("horizon_hours"))
        .groupBy(*keys, "horizon_hours")
        .agg(F.min("_free").alias("free_gpus"), F.count(F.lit(1)).alias("_points"))
    )


def quota_plan(
    points: DataFrame,
    capacity: Column,
    etas: Sequence[float],
    config: SeasonalConfig = SeasonalConfig(),
) -> DataFrame:
    """Aggregate quota per guarantee horizon and eta."""
    free = F.greatest(F.lit(0.0), capacity - F.col("guarantee_quantile_gpus"))
    tight = _tightest_free(points, [], free, config.guarantee_horizons_hours).select(
        "*", F.explode(F.array(*[F.lit(float(e)) for e in etas])).alias("eta")
    )
    scaled = F.floor(F.col("free_gpus") * F.col("eta") + EPSILON).cast("double")
    return tight.select(
        "eta",
        F.col("horizon_hours").cast("long").alias("horizon_hours"),
        rounded(F.col("free_gpus")).alias("free_gpus"),
        _clip(scaled, 0.0, capacity).cast("long").alias("spot_quota_gpus"),
    )


def tenant_quota(
    points: DataFrame,
    keys: Sequence[str],
    state: DataFrame,
    horizons: Sequence[int] = (1, 2, 4),
    runtime_inventory_cap: bool = True,
) -> DataFrame:
    """Pool quota from forecast quantiles, eta and what the pool can physically give.

    ``state`` carries capacity, eta, idle and running Spot GPUs per key. A horizon with too few
    forecast points has no quota, which is how an unready history is kept closed.
    """
    joined = points.join(state, list(keys))
    capacity = F.col("capacity_gpus")
    reserved = _clip(
        F.floor(F.col("guarantee_quantile_gpus") + EPSILON).cast("double"), 0.0, capacity
    )
    tight = _tightest_free(joined, keys, capacity - reserved, horizons)
    wanted = F.array(*[F.lit(h) for h in horizons])
    every = state.select("*", F.explode(wanted).alias("horizon_hours"))
    quota = F.col("free_gpus") * F.col("eta")
    if runtime_inventory_cap:
        quota = F.least(quota, F.col("idle_gpus") + F.col("running_spot_gpus"))
    ready = F.col("_points") >= F.col("horizon_hours")
    return every.join(tight, [*keys, "horizon_hours"], "left").select(
        *keys,
        F.col("horizon_hours").cast("long").alias("horizon_hours"),
        rounded(F.when(ready, F.col("free_gpus")).otherwise(0.0)).alias("free_gpus"),
        F.when(ready, _clip(F.floor(quota + EPSILON).cast("double"), 0.0, capacity))
        .otherwise(0.0)
        .cast("long")
        .alias("spot_quota_gpus"),
    )


def pool_gaussians(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of independent Normals."""
    return components.groupBy(*keys).agg(
        F.sum("mu_gpus").alias("mu_gpus"),
        F.sqrt(F.sum(F.col("sigma_gpus") * F.col("sigma_gpus"))).alias("sigma_gpus"),
    )


def residual_calibration(
    residuals: DataFrame, keys: Sequence[str], probability: float = 0.9
) -> DataFrame:
    """Nearest-rank offset per pool, with coverage before and after applying it."""
    offset = exact_quantiles(
        residuals, keys, "residual_gpus", {"offset": probability}, discrete=True
    ).withColumn("offset", rounded(F.col("offset")))
    n = F.count(F.lit(1))
    return (
        residuals.join(offset, list(keys))
        .groupBy(*keys, "offset")
        .agg(
            n.alias("sample_count"),
            rounded(F.count_if(F.col("residual_gpus") <= 0.0) / n, 9).alias("raw_coverage"),
            rounded(F.count_if(F.col("residual_gpus") <= F.col("offset") + EPSILON) / n, 9).alias(
                "calibrated_coverage"
            ),
        )
        .withColumnRenamed("offset", "quantile_offset_gpus")
        .withColumn(
            "nearest_rank",
            F.least(
                F.col("sample_count"),
                F.greatest(F.lit(1), F.ceil(F.col("sample_count") * F.lit(probability))),
            ).cast("long"),
        )
    )


def score_forecasts(
    targets: DataFrame, actuals: DataFrame, keys: Sequence[str], probability: float = 0.9
) -> DataFrame:
    """Score each target once its observation exists; unobserved targets are dropped.

    Times meet on whole microseconds. The aggregate and tenant reports use opposite error signs,
    so both are given.
    """
    micros = lambda c: F.round(F.col(c) * 1e6).cast("long")
    matched = targets.withColumn("_t", micros("target_time_seconds")).join(
        actuals.select(*keys, micros("sample_time_seconds").alias("_t"), "actual_gpus"),
        [*keys, "_t"],
    )
    actual, mu, q = F.col("actual_gpus"), F.col("mu_gpus"), F.col("guarantee_quantile_gpus")
    gap = actual - q
    pinball = F.greatest(probability * gap, (probability - 1.0) * gap)
    n = F.count(F.lit(1))
    return matched.groupBy(*keys).agg(
        n.alias("scored_point_count"),
        rounded(F.avg(F.abs(actual - mu))).alias("mae_gpus"),
        F.when(F.sum(actual) > 0, rounded(F.sum(F.abs(actual - mu)) / F.sum(actual), 9)).alias(
            "wape"
        ),
        rounded(F.avg(actual - mu)).alias("aggregate_mean_error_gpus"),
        rounded(F.avg(mu - actual)).alias("tenant_mean_error_gpus"),
        rounded(F.count_if(actual <= q + EPSILON) / n, 9).alias("coverage"),
        rounded(F.avg(pinball)).alias("pinball_loss"),
    )


def admission_diagnostics(updates: DataFrame, interval_seconds: float) -> DataFrame:
    """How often, and at what idle cost, a zero quota met idle GPUs and a Spot backlog."""
    stuck = (
        (F.col("spot_quota_gpus") == 0)
        & (F.col("idle_gpus") > EPSILON)
        & (F.col("spot_backlog_gpus") > EPSILON)
    )
    n = F.count(F.lit(1))
    return updates.agg(
        n.alias("pool_update_count"),
        F.count_if(stuck).alias("zero_quota_with_idle_backlog_count"),
        rounded(F.count_if(stuck) / n, 9).alias("zero_quota_with_idle_backlog_fraction"),
        rounded(
            F.coalesce(F.sum(F.when(stuck, F.col("idle_gpus"))), F.lit(0.0)) * float(interval_seconds)
        ).alias("estimated_idle_gpu_seconds"),
        rounded(
            F.coalesce(F.max(F.when(stuck, F.col("maximum_spot_wait_seconds"))), F.lit(0.0))
        ).alias("maximum_spot_wait_seconds"),
    )


ETA_BLOCK = 512


def fold_clipped(
    factors: DataFrame, keys: Sequence[str], initial: float, low: float, high: float, block: int = ETA_BLOCK
) -> DataFrame:
    """Eta after every tick of the law eta' = clip(factor * eta, low, high).

    ``factors``: keys, tick, factor > 0. Such steps compose to clip(a * x, l, h), so each block of ticks is
    reduced to one map, the maps are folded over the blocks, and every block then walks its own ticks
    from where the blocks before it end. A task holds a block, or one row per block of its key.
    """
    lo, hi = F.lit(low), F.lit(high)
    clip = lambda x: F.greatest(lo, F.least(hi, x))
    blocks = factors.withColumn("_b", F.floor(F.col("tick") / block)).groupBy(*keys, "_b").agg(
        F.array_sort(F.collect_list(F.struct("tick", "factor"))).alias("_steps")
    )

    def compose(m: Column, step: Column) -> Column:
        f = step["factor"]
        return F.struct((m["a"] * f).alias("a"), clip(m["l"] * f).alias("l"), clip(m["h"] * f).alias("h"))

    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("l"), F.lit(float("inf")).alias("h"))
    maps = blocks.withColumn("_map", F.aggregate("_steps", same, compose))

    def enter(state: Column, m: Column) -> Column:
        into = F.struct(m["_b"].alias("_b"), state["x"].alias("eta"))
        return F.struct(
            F.greatest(m["_map"]["l"], F.least(m["_map"]["h"], m["_map"]["a"] * state["x"])).alias("x"),
            F.array_append(state["path"], into).alias("path"),
        )

    begin = F.struct(F.lit(initial).alias("x"), F.array().cast("array<struct<_b:bigint,eta:double>>").alias("path"))
    ordered = F.array_sort(F.collect_list(F.struct("_b", "_map")))
    entering = maps.groupBy(*keys).agg(ordered.alias("_m")).select(
        *keys, F.inline(F.aggregate("_m", begin, enter, lambda s: s["path"]))
    )

    def walk(state: Column, step: Column) -> Column:
        eta = clip(state["eta"] * step["factor"])
        return F.struct(
            eta.alias("eta"),
            F.array_append(state["path"], F.struct(step["tick"].alias("tick"), eta.alias("eta"))).alias("path"),
        )

    start = F.struct(F.col("_eta").alias("eta"), F.array().cast("array<struct<tick:bigint,eta:double>>").alias("path"))
    return blocks.join(entering.withColumnRenamed("eta", "_eta"), [*keys, "_b"]).select(
        *keys, F.inline(F.aggregate("_steps", start, walk, lambda s: s["path"]))
    )


def eta_trajectory(
    updates: DataFrame, keys: Sequence[str], config: TenantConfig = TenantConfig()
) -> DataFrame:
    """Eta after every update of each pool: keys, tick, eta.

    ``updates``: keys, tick, eviction_rate, maximum_spot_wait_seconds. Each update is a factor on eta.
    """
    target = 1.0 - config.guarantee_probability
    rate = F.col("eviction_rate")
    high = rate >= config.high_eviction_multiple * target
    low = (rate <= config.low_eviction_multiple * target) & (
        F.col("maximum_spot_wait_seconds") > config.queue_wait_threshold_seconds
    )
    factor = (
        F.when(F.coalesce(high, F.lit(False)), F.lit(target) / rate)
        .when(F.coalesce(low, F.lit(False)), F.lit(1.5) - rate / F.lit(target))
        .otherwise(1.0)
    )
    steps = updates.select(*keys, F.col("tick").cast("long").alias("tick"), factor.alias("factor"))
    return fold_clipped(steps, keys, config.initial_eta, config.minimum_eta, config.maximum_eta)


def aggregate_eta_trajectory(
    updates: DataFrame, keys: Sequence[str], config: SeasonalConfig = SeasonalConfig()
) -> DataFrame:
    """Eta after every update under the aggregate law: keys, tick, eta.

    ``updates``: keys, tick, now_seconds, eviction_rate, new_runs (whether runs ended since the
    last change) and spot_backlog_gpus. New outcomes move eta by the eviction rate; without them a
    backlog older than the starvation limit raises it. How long a backlog lasts does not depend on eta,
    so it is a window over the updates, and each update is a factor on eta.
    """
    target = 1.0 - config.guarantee_probability
    rise = 1.0 + config.eta_increase_step
    ordered = Window.partitionBy(*keys).orderBy("tick")
    backlog = F.col("spot_backlog_gpus") > 0
    spell = F.count_if(~backlog).over(ordered)
    began = F.min(F.when(backlog, F.col("now_seconds"))).over(
        Window.partitionBy(*keys, "_spell").orderBy("tick")
    )
    rate = F.col("eviction_rate")
    judged = F.col("new_runs") & rate.isNotNull()
    high = (rate >= config.high_eviction_ratio * target) & (rate > 0)
    low = (rate <= config.low_eviction_ratio * target) & backlog
    starving = F.coalesce(
        backlog & (F.col("now_seconds") - began >= config.starvation_increase_after_seconds), F.lit(False)
    )
    factor = (
        F.when(judged & high, F.lit(target) / rate)
        .when(judged & low, rise)
        .when(judged, 1.0)
        .when(starving, rise)
        .otherwise(1.0)
    )
    steps = updates.withColumn("_spell", spell).select(*keys, F.col("tick").cast("long").alias("tick"), factor.alias("factor"))
    return fold_clipped(steps, keys, config.initial_eta, config.minimum_eta, config.maximum_eta)
