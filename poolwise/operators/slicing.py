"""Filters that carve a trace, and the checks a trace must pass."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ANY_POOL, EPSILON, SERVICE_CLASSES, Trace
from ..functions import broadcast_if_small


def pool_capacity(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("gpu_model").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.sum("gpu_count").cast("double").alias("capacity_gpus"),
    )


def total_capacity(nodes: DataFrame) -> Column:
    """The cluster's GPU count, read once so later plans carry a literal."""
    return one_value(nodes, F.sum("gpu_count").cast("double"))


def one_value(df: DataFrame, aggregate: Column) -> Column:
    """A single aggregated number as a literal."""
    return F.lit(df.agg(aggregate.alias("value")).first()["value"])


def with_eligible_capacity(trace: Trace) -> DataFrame:
    """Attach the capacity a job may use: its own pool's, or the whole cluster's for ``*``."""
    capacity = broadcast_if_small(pool_capacity(trace.nodes).select("gpu_model", "capacity_gpus"))
    return trace.jobs.join(capacity, "gpu_model", "left").withColumn(
        "eligible_capacity_gpus",
        F.when(F.col("gpu_model") == ANY_POOL, total_capacity(trace.nodes)).otherwise(
            F.coalesce("capacity_gpus", F.lit(0.0))
        ),
    ).drop("capacity_gpus")


def capacity_feasibility(trace: Trace) -> DataFrame:
    return (
        with_eligible_capacity(trace)
        .groupBy("gpu_model")
        .agg(
            F.count(F.lit(1)).alias("job_count"),
            F.count_if(F.col("gpu_count") > F.col("eligible_capacity_gpus")).alias(
                "infeasible_job_count"
            ),
            F.max("gpu_count").alias("largest_request_gpus"),
            F.max("eligible_capacity_gpus").alias("eligible_capacity_gpus"),
        )
    )


def validate_trace(trace: Trace, *, tenant_required: bool = True) -> DataFrame:
    """One row per declared rule with the number of rows that break it."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    job_rules = {
        "job_id_empty": blank("job_id"),
        "service_class_unsupported": ~F.coalesce(
            F.col("service_class").isin(*SERVICE_CLASSES), F.lit(False)
        ),
        "job_gpu_model_empty": blank("gpu_model"),
        "submit_time_negative": ~(F.col("submit_time_seconds") >= 0),
        "duration_not_positive": ~(F.col("duration_seconds") > 0),
        "gpu_count_not_positive": ~(F.col("gpu_count") > 0),
        "request_exceeds_eligible_capacity": F.col("gpu_count") > F.col("eligible_capacity_gpus"),
    }
    if tenant_required:
        job_rules["tenant_id_empty"] = blank("tenant_id")
    node_rules = {
        "node_id_empty": blank("node_id"),
        "node_gpu_model_empty": blank("gpu_model"),
        "node_gpu_count_not_positive": ~(F.col("gpu_count") > 0),
    }

    def count_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
        wide = df.agg(*[F.count_if(condition).alias(name) for name, condition in rules.items()])
        pairs = F.array(
            *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violation_count")) for n in rules]
        )
        return wide.select(F.inline(pairs))

    def count_repeats(df: DataFrame, key: str, rule: str) -> DataFrame:
        return (
            df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.count_if(F.col("n") > 1).alias("violation_count"))
            .select(F.lit(rule).alias("rule"), "violation_count")
        )

    return (
        count_rules(with_eligible_capacity(trace), job_rules)
        .unionByName(count_rules(trace.nodes, node_rules))
        .unionByName(count_repeats(trace.jobs, "job_id", "job_id_repeated"))
        .unionByName(count_repeats(trace.nodes, "node_id", "node_id_repeated"))
    )


def extent_rules(trace: Trace) -> dict[str, bool]:
    """Rules over the whole trace: rows exist, and an evaluation window fits the arrivals. True is a breach."""
    start, end = trace.evaluation_start_seconds, trace.evaluation_end_seconds
    at = F.col("submit_time_seconds")
    inside = F.count_if(at.between(start, end)) if start is not None else F.lit(0)
    row = trace.jobs.agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), inside.alias("inside")
    ).first()
    broken = {"jobs_empty": row.n == 0, "nodes_empty": trace.nodes.isEmpty()}
    if start is not None and row.n:
        broken |= {
            "window_starts_before_first_arrival": row.first > start,
            "arrivals_after_window": row.last > end,
            "window_without_arrivals": row.inside == 0,
        }
    return broken


def require_valid(trace: Trace, *, tenant_required: bool = True) -> Trace:
    broken = (
        validate_trace(trace, tenant_required=tenant_required).where("violation_count > 0").collect()
    )
    listed = [f"{row.rule}={row.violation_count}" for row in broken]
    listed += [rule for rule, hit in extent_rules(trace).items() if hit]
    if listed:
        raise ValueError(f"Trace breaks its contract: {', '.join(listed)}")
    return trace


def last_wins(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of tables in which, for equal keys, the row of the last table stays.

    A key has at most a row for each table, so the shuffle carries partial maxima only.
    """
    columns = sources[0].columns
    rest = [c for c in columns if c not in keys]
    tagged = [
        df.select(*keys, F.struct(F.lit(i).alias("_source"), *rest).alias("_row")) for i, df in enumerate(sources)
    ]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df)
    return union.groupBy(*keys).agg(F.max("_row").alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in columns])


def slice_prefix(
    trace: Trace, max_submit_time_seconds: float, gpu_models: Iterable[str] | None = None
) -> Trace:
    """Inclusive arrival prefix; nodes survive only for pools some kept job names."""
    if max_submit_time_seconds < 0:
        raise ValueError("max_submit_time_seconds cannot be negative")
    jobs = trace.jobs.where(F.col("submit_time_seconds") <= float(max_submit_time_seconds))
    if gpu_models is not None:
        jobs = jobs.where(F.col("gpu_model").isin(*sorted(gpu_models), ANY_POOL))
    named = jobs.where(F.col("gpu_model") != ANY_POOL).select("gpu_model").distinct()
    only_wildcards = named.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    nodes = (
        trace.nodes.join(named.withColumn("_named", F.lit(True)), "gpu_model", "left")
        .where(F.col("_named") | only_wildcards)
        .drop("_named")
    )
    return Trace(nodes, jobs, trace.trace_id, trace.time_origin)


def slice_window(
    trace: Trace, warmup_start: float, evaluation_start: float, evaluation_end: float
) -> Trace:
    if not 0 <= warmup_start <= evaluation_start < evaluation_end:
        raise ValueError("Expected 0 <= warm-up start <= evaluation start < evaluation end")
    jobs = trace.jobs.where(
        F.col("submit_time_seconds").between(float(warmup_start), float(evaluation_end))
    )
    return Trace(
        trace.nodes,
        jobs,
        trace.trace_id,
        trace.time_origin,
        float(evaluation_start),
        float(evaluation_end),
    )


def in_population(start: float, end: float) -> Column:
    return F.col("submit_time_seconds").between(float(start), float(end))


def as_of(jobs: DataFrame, cutoff: float) -> DataFrame:
    """The leakage fence: arrivals visible at a cutoff, flagged when already complete."""
    limit = float(cutoff) + EPSILON
    finish = F.col("submit_time_seconds") + F.col("duration_seconds")
    return jobs.where(F.col("submit_time_seconds") <= limit).withColumn(
        "completed_by_cutoff", finish <= limit
    )
