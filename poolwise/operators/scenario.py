"""Scenario traces of a cutoff: what still runs, past arrivals moved ahead, and pieces of the HP forecast.

Nothing here looks past the cutoff, and nothing is placed: a scenario is a job table with one fingerprint a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import EPSILON, HOUR
from ..functions import ordered_positions
from .fingerprints import canonical_text
from .slicing import last_wins

#: The columns of a scenario job, beside ``origin`` and its fingerprint.
JOB = ("submit_time_seconds", "duration_seconds", "gpu_count", "service_class", "gpu_model", "tenant_id")


def shifted_history(jobs: DataFrame, *, interval: float, horizon: float, decisions: Column) -> DataFrame:
    """Jobs that came and ended in ``(cutoff - horizon, cutoff]``, moved ahead by ``horizon``, for every cutoff.

    Cutoffs are ``k * interval`` for ``k = 1 .. decisions``. A job is written once for each of the few cutoffs whose
    span holds its arrival, so the work is linear in the jobs where the interval is not below the horizon.
    ``position`` numbers the jobs of a cutoff by arrival and job_id.
    """
    submit = F.col("submit_time_seconds")
    first = F.greatest(F.lit(1), F.ceil((submit - EPSILON) / interval)).cast("long")
    last = F.least(decisions, F.ceil((submit + horizon) / interval) - 1).cast("long")
    ended = submit + F.col("duration_seconds") <= F.col("decision") * interval + EPSILON
    placed = (
        jobs.withColumns({"_first": first, "_last": last})
        .where("_first <= _last")
        .select("job_id", *JOB, F.explode(F.sequence("_first", "_last")).alias("decision"))
        .where(ended)
    )
    numbered = ordered_positions(placed, ["decision"], ["submit_time_seconds", "job_id", "service_class"])
    return numbered.withColumn("submit_time_seconds", submit + horizon)


def visible_completed(trace_jobs: DataFrame, workload_jobs: DataFrame, cutoff: float) -> DataFrame:
    """Jobs of either log that ended by the cutoff; where both name one, the workload's row counts."""
    ended = F.col("submit_time_seconds") + F.col("duration_seconds") <= cutoff + EPSILON
    both = [df.where(ended).select("job_id", *JOB) for df in (trace_jobs, workload_jobs)]
    return last_wins(both, ["job_id", "service_class"])


def _named(df: DataFrame, origin: str, *parts: Column, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.concat_ws("::", F.lit(origin), *parts).alias("scenario_job_id"), F.lit(origin).alias("origin"), *JOB)


def _digits(column: str, n: int) -> Column:
    """As text of at least ``n`` digits."""
    text = F.col(column).cast("string")
    return F.lpad(text, F.greatest(F.lit(n), F.length(text)), F.lit("0"))


def history_jobs(history: DataFrame, *keep: str) -> DataFrame:
    return _named(history, "history", _digits("position", 6), F.col("job_id"), keep=keep)


def carried_jobs(estimates: DataFrame, cutoff: float) -> DataFrame:
    """Jobs that still hold GPUs, as arrivals at the cutoff that run for their estimated remaining time."""
    began = estimates.withColumn("_began", -F.col("elapsed_seconds"))
    rows = ordered_positions(began, [], ["_began", "job_id", "service_class"]).withColumns(
        {"submit_time_seconds": F.lit(float(cutoff)), "duration_seconds": F.col("estimated_remaining_seconds")}
    )
    return _named(rows, "carryover", _digits("position", 6), F.col("job_id"))


def forecast_jobs(pieces: DataFrame, cutoff: float, horizon: float) -> DataFrame:
    """Pieces of the forecast as HP arrivals an hour before their target, within the horizon."""
    target = F.col("target_time_seconds")
    lasts = F.least(F.lit(float(HOUR)), F.lit(cutoff + horizon) - (target - HOUR))
    rows = pieces.withColumns(
        {
            "submit_time_seconds": F.greatest(F.lit(float(cutoff)), target - HOUR),
            "duration_seconds": F.greatest(F.lit(60.0), lasts),
            "service_class": F.lit("HP"),
        }
    )
    return _named(rows, "forecast-hp", _digits("point_index", 6), _digits("piece_index", 4), F.col("gpu_model"))


def scenario_jobs(carried: DataFrame, history: DataFrame, forecast: DataFrame | None) -> DataFrame:
    """The job table of a scenario; past HP arrivals stand in for the forecast only where there is none."""
    if forecast is not None:
        history = history.where(F.col("service_class") != "HP").unionByName(forecast)
    return with_fingerprints(carried.unionByName(history))


def with_fingerprints(jobs: DataFrame) -> DataFrame:
    """SHA-256 over a job's fields, times and sizes in millionths."""
    millionths = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    text = canonical_text(
        {
            "job": F.col("scenario_job_id"),
            "submit": millionths("submit_time_seconds"),
            "duration": millionths("duration_seconds"),
            "gpus": millionths("gpu_count"),
            "class": F.col("service_class"),
            "pool": F.col("gpu_model"),
            "tenant": F.col("tenant_id"),
        }
    )
    return jobs.withColumn("job_fingerprint", F.sha2(text, 256))
