"""Tenant demand model: linear Gaussian forecasts trained by distributed gradient sums.

For a series with history x, split into trend and cycle, and horizon step h:

    mean_h  = a_h . cycle + b_h . trend + time biases + series bias
    sigma_h = softplus(c_h . x + time biases + series bias)

The loss is the Gaussian negative log-likelihood of non-zero targets. Training rows stay where Spark
put them: each partition sums its gradient, the sums are added by key, and only the shared parameters visit
the driver. Biases are a DataFrame with one row per series, joined to the rows by the series key; their
gradients are added and their steps taken on Spark. A series without training rows has bias zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal_quantile, rounded
from ..functions.sizing import broadcast_if_small
from ..session import cut_lineage, ship_package
from .forecast import pool_gaussians, residual_calibration

SERIES = ["gpu_model", "tenant_id"]
TIME_SLOTS = 2 + 7 + 24
BIASES = ("mean_bias", "scale_bias")


@dataclass(frozen=True)
class TenantModel:
    lookback: int = 672
    horizon: int = 4
    moving_average_window: int = 25
    epochs: int = 10
    learning_rate: float = 0.00004
    patience: int = 3
    validation_hours: int = 168
    probability: float = 0.9


def training_rows(hours: DataFrame, model: TenantModel, origin_weekday: int = 0, business: DataFrame | None = None) -> DataFrame:
    """Lookback, cycle and target arrays at every hour of every series.

    ``hours``: series columns, bucket, gpus. Arrays are as long as the lookback, so a row is bounded
    whatever the history. ``origin_weekday`` is the weekday of bucket zero, Monday being 0. ``business`` has day_index
    and workday (``calendar.day_flags``); without it, or on days it lacks, the weekday decides.
    """
    ordered = Window.partitionBy(*SERIES).orderBy("bucket")
    history = ordered.rowsBetween(-(model.lookback - 1), 0)
    ahead = ordered.rowsBetween(1, model.horizon)
    arrays = hours.select(
        *SERIES,
        "bucket",
        F.collect_list("gpus").over(history).alias("x"),
        F.collect_list("gpus").over(ahead).alias("y"),
    ).where(F.size("x") == model.lookback)
    moment = F.col("bucket") + 1
    weekday = F.pmod(F.floor(moment / 24) + origin_weekday, F.lit(7)).cast("int")
    by_weekday = (weekday < 5).cast("int")
    placed = arrays.withColumns({"hour": F.pmod(moment, F.lit(24)).cast("int"), "weekday": weekday, "day_index": F.floor(moment / 24).cast("long")})
    if business is None:
        return placed.withColumn("workday", by_weekday).drop("day_index")
    flagged = placed.join(broadcast_if_small(business.select("day_index", "workday")), "day_index", "left")
    return flagged.withColumn("workday", F.coalesce("workday", (F.col("weekday") < 5).cast("int"))).drop("day_index")


def _design(frame: pd.DataFrame, model: TenantModel) -> tuple[np.ndarray, np.ndarray]:
    """(mean inputs, scale inputs): history parts with one-hot time slots."""
    x = np.array(frame["x"].tolist(), dtype=float)
    half = (model.moving_average_window - 1) // 2
    padded = np.pad(x, ((0, 0), (half, half)), mode="edge")
    total = np.cumsum(np.pad(padded, ((0, 0), (1, 0))), axis=1)
    width = model.moving_average_window
    trend = (total[:, width:] - total[:, :-width]) / width
    slots = np.zeros((len(frame), TIME_SLOTS))
    at = np.arange(len(frame))
    slots[at, frame["workday"]] = 1.0
    slots[at, 2 + frame["weekday"].to_numpy()] = 1.0
    slots[at, 9 + frame["hour"].to_numpy()] = 1.0
    return np.hstack([x - trend, trend, slots]), np.hstack([x, slots])


def _initial(model: TenantModel, series: int | None) -> dict[str, np.ndarray]:
    """Initial parameters; with biases if the series are indexed."""
    start, h = 1.0 / model.lookback, model.horizon
    mean = np.zeros((2 * model.lookback + TIME_SLOTS, h))
    scale = np.zeros((model.lookback + TIME_SLOTS, h))
    mean[: 2 * model.lookback], scale[: model.lookback] = start, start
    shared = {"mean": mean, "scale": scale}
    return shared if series is None else shared | {name: np.zeros((series, h)) for name in BIASES}


def _predict(weights, design, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide, narrow = design
    if "mean_bias" in weights:
        mean_bias, scale_bias = (weights[name][frame["series_index"].to_numpy()] for name in BIASES)
    else:
        mean_bias, scale_bias = (np.array(frame[name].tolist(), dtype=float) for name in BIASES)
    mean = wide @ weights["mean"] + mean_bias
    raw = narrow @ weights["scale"] + scale_bias
    return mean, np.logaddexp(0.0, raw) + 1e-6, raw


def _joined_by_series(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the row of ``right`` that has the same series, null keys alike."""
    named = right.select(*[F.col(c).alias("of_" + c) for c in SERIES], *values)
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col("of_" + c)) for c in SERIES))
    return left.join(broadcast_if_small(named), same, "left").drop(*["of_" + c for c in SERIES])


def _with_biases(rows: DataFrame, biases: DataFrame, model: TenantModel) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), model.horizon)
    joined = _joined_by_series(rows, biases, list(BIASES))
    return joined.withColumns({name: F.coalesce(name, zeros) for name in BIASES})


def _initial_biases(rows: DataFrame, model: TenantModel) -> DataFrame:
    """One row per series: each bias of every horizon step, and the two moments of its gradient."""
    zeros = F.array_repeat(F.lit(0.0), model.horizon)
    names = [name + part for name in BIASES for part in ("", "_first", "_second")]
    return cut_lineage(rows.select(*SERIES).distinct().select(*SERIES, *[zeros.alias(n) for n in names]))


def _stepped_biases(biases: DataFrame, added: DataFrame, fit_n: float, rate: float, epoch: int, model: TenantModel) -> DataFrame:
    """The biases after one step of Adam, from the sums of their gradients."""
    total = lambda name, k: F.sum(F.when((F.col("parameter") == name) & (F.col("position") == k), F.col("total")))
    gradients = added.where(F.col("parameter").isin(*BIASES)).groupBy(*SERIES).agg(
        *[
            F.array(*[F.coalesce(total(name, k), F.lit(0.0)) / float(fit_n) for k in range(model.horizon)]).alias(name + "_gradient")
            for name in BIASES
        ]
    )
    joined = _joined_by_series(biases, gradients, [name + "_gradient" for name in BIASES])
    zeros = F.array_repeat(F.lit(0.0), model.horizon)
    columns = []
    for name in BIASES:
        gradient = F.coalesce(F.col(name + "_gradient"), zeros)
        first = F.zip_with(name + "_first", gradient, lambda m, g: 0.9 * m + 0.1 * g)
        second = F.zip_with(name + "_second", gradient, lambda m, g: 0.999 * m + 0.001 * g * g)
        step = F.zip_with(
            first,
            second,
            lambda a, b: rate * (a / (1 - 0.9 ** (epoch + 1))) / (F.sqrt(b / (1 - 0.999 ** (epoch + 1))) + 1e-8),
        )
        columns += [
            F.zip_with(name, step, lambda v, d: v - d).alias(name),
            first.alias(name + "_first"),
            second.alias(name + "_second"),
        ]
    return cut_lineage(joined.select(*SERIES, *columns))


def _gradient_sums(rows: DataFrame, weights, model: TenantModel) -> DataFrame:
    """Losses and gradients over all rows, added up by (series, parameter, position).

    Only biases that ``rows`` brings along as columns are added by series; other rows have no series.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    indexed = "mean_bias" in weights

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        sums = {name: np.zeros_like(value) for name, value in w.items()}
        sums["loss"] = np.zeros(4)
        for frame in batches:
            if not len(frame):
                continue
            design = _design(frame, model)
            target = np.array(frame["y"].tolist(), dtype=float)
            held = frame["validation"].to_numpy()
            mean, sigma, raw = _predict(w, design, frame)
            used = target != 0
            gap = (target - mean) / sigma
            nll = np.log(sigma) + 0.5 * gap**2 + 0.5 * np.log(2 * np.pi)
            for slot, rows_of in ((0, ~held), (2, held)):
                mask = used & rows_of[:, None]
                sums["loss"][slot] += nll[mask].sum()
                sums["loss"][slot + 1] += mask.sum()
            fit = used & ~held[:, None]
            d_mean = np.where(fit, -gap / sigma, 0.0)
            d_raw = np.where(fit, (1.0 - gap**2) / sigma, 0.0) / (1.0 + np.exp(-raw))
            sums["mean"] += design[0].T @ d_mean
            sums["scale"] += design[1].T @ d_raw
            if indexed:
                index = frame["series_index"].to_numpy()
                np.add.at(sums["mean_bias"], index, d_mean)
                np.add.at(sums["scale_bias"], index, d_raw)
                continue
            for name, value in zip(BIASES, (d_mean, d_raw), strict=True):
                for step in range(model.horizon):
                    part = frame[SERIES].assign(total=value[:, step]).groupby(SERIES, dropna=False, as_index=False).sum()
                    yield part.assign(parameter=name, position=step)[[*SERIES, "parameter", "position", "total"]]
        for name, value in sums.items():
            flat = value.ravel()
            place = np.flatnonzero(flat)
            yield pd.DataFrame(
                {"gpu_model": None, "tenant_id": None, "parameter": name, "position": place.astype("int64"), "total": flat[place]}
            )

    return (
        rows.mapInPandas(partial, "gpu_model string, tenant_id string, parameter string, position long, total double")
        .groupBy(*SERIES, "parameter", "position")
        .agg(F.sum("total").alias("total"))
    )


def _on_driver(added: DataFrame, weights) -> dict[str, np.ndarray]:
    """The sums of the losses and of the gradients of ``weights``."""
    result = {name: np.zeros(value.size) for name, value in weights.items()} | {"loss": np.zeros(4)}
    found = added.where(F.col("parameter").isin(*result)).select("parameter", "position", "total").toPandas()
    for name, part in found.groupby("parameter"):
        result[name][part["position"].to_numpy()] = part["total"].to_numpy()
    return {n: v.reshape(weights[n].shape) if n in weights else v for n, v in result.items()}


def _gradient_job(rows: DataFrame, weights, model: TenantModel) -> dict[str, np.ndarray]:
    return _on_driver(_gradient_sums(rows, weights, model), weights)


def train(rows: DataFrame, series: int | None, model: TenantModel) -> tuple[dict, list[dict]]:
    """Full-batch Adam with halving rate, early stopping on validation loss, best weights kept.

    ``series`` counts the values of ``series_index``, whose biases are arrays on the driver; with None the
    biases are a DataFrame by series, returned as ``biases``.
    """
    weights = _initial(model, series)
    biases = _initial_biases(rows, model) if series is None else None
    first = {n: np.zeros_like(v) for n, v in weights.items()}
    second = {n: np.zeros_like(v) for n, v in weights.items()}
    best, best_loss, stale, log = weights, np.inf, 0, []
    for epoch in range(model.epochs + 1):
        added = _gradient_sums(rows if biases is None else _with_biases(rows, biases, model), weights, model).persist()
        sums = _on_driver(added, weights)
        fit, fit_n, held, held_n = sums["loss"]
        if not fit_n or not held_n:
            raise ValueError("Training or validation has no usable targets")
        log.append({"epoch": epoch, "train_nll": fit / fit_n, "validation_nll": held / held_n})
        if held / held_n + 1e-9 < best_loss:
            best, best_loss, stale = weights if biases is None else weights | {"biases": biases}, held / held_n, 0
        else:
            stale += 1
            if stale >= model.patience:
                break
        if epoch == model.epochs:
            break
        rate = model.learning_rate * 0.5 ** (max(0, epoch - 1) // 3)
        updated = {}
        for name, value in weights.items():
            gradient = sums[name] / fit_n
            first[name] = 0.9 * first[name] + 0.1 * gradient
            second[name] = 0.999 * second[name] + 0.001 * gradient**2
            unbiased = first[name] / (1 - 0.9 ** (epoch + 1))
            spread = np.sqrt(second[name] / (1 - 0.999 ** (epoch + 1)))
            updated[name] = value - rate * unbiased / (spread + 1e-8)
        weights = updated
        if biases is not None:
            biases = _stepped_biases(biases, added, fit_n, rate, epoch, model)
        added.unpersist()
    return best, log


def predict(rows: DataFrame, weights, model: TenantModel) -> DataFrame:
    """Mean and sigma of every row and horizon step."""
    if "biases" in weights:
        rows = _with_biases(rows, weights["biases"], model)
    shared = rows.sparkSession.sparkContext.broadcast({n: w for n, w in weights.items() if n != "biases"})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            mean, sigma, _ = _predict(shared.value, _design(frame, model), frame)
            for step in range(model.horizon):
                part = frame[["gpu_model", "tenant_id", "bucket"]].copy()
                part["horizon_step"] = step + 1
                part["mu_gpus"], part["sigma_gpus"] = mean[:, step], sigma[:, step]
                part["actual_gpus"] = [y[step] if len(y) > step else None for y in frame["y"]]
                yield part

    return rows.mapInPandas(
        score,
        "gpu_model string, tenant_id string, bucket long, horizon_step int, mu_gpus double, "
        "sigma_gpus double, actual_gpus double",
    )


def forecast_pools(
    hours: DataFrame, cutoff: float, model: TenantModel, origin_weekday: int = 0, business: DataFrame | None = None
) -> DataFrame:
    """Calibrated pool forecasts at the cutoff, from hours complete by then."""
    ship_package(hours.sparkSession)
    last = int(cutoff // 3600) - 1
    seen = hours.where(F.col("bucket") <= last)
    edge = last - model.validation_hours
    rows = cut_lineage(
        training_rows(seen, model, origin_weekday, business)
        .withColumn("validation", F.col("bucket") > edge)
    )
    complete = F.size("y") == model.horizon
    gap = F.col("validation") | (F.col("bucket") + model.horizon <= edge)
    weights, _ = train(rows.where(complete & gap), None, model)
    z = normal_quantile(model.probability)
    key = ["gpu_model", "bucket", "horizon_step"]
    held = predict(rows.where(complete & F.col("validation")), weights, model)
    actual = held.groupBy(*key).agg(F.sum("actual_gpus").alias("actual"))
    residuals = pool_gaussians(held, key).join(actual, key).select(
        "gpu_model",
        (F.col("actual") - (F.col("mu_gpus") + z * F.col("sigma_gpus"))).alias("residual_gpus"),
    )
    offsets = residual_calibration(cut_lineage(residuals), ["gpu_model"], model.probability)
    newest = predict(rows.where(F.col("bucket") == last), weights, model)
    raw = F.col("mu_gpus") + z * F.col("sigma_gpus")
    return (
        pool_gaussians(newest, ["gpu_model", "horizon_step"])
        .join(offsets, "gpu_model")
        .select(
            "gpu_model",
            "horizon_step",
            (F.lit(float(cutoff)) + F.col("horizon_step") * 3600.0).alias("target_time_seconds"),
            rounded(F.col("mu_gpus")).alias("mu_gpus"),
            rounded(F.col("sigma_gpus")).alias("sigma_gpus"),
            rounded(raw).alias("raw_guarantee_quantile_gpus"),
            rounded(F.col("quantile_offset_gpus")).alias("quantile_calibration_offset_gpus"),
            rounded(F.greatest(F.lit(0.0), raw + F.col("quantile_offset_gpus"))).alias(
                "guarantee_quantile_gpus"
            ),
        )
    )
