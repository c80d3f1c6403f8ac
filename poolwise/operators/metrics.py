"""Metrics of a given run ledger, all relational over the run rows.

A run row has run_id, action_id, job_id, service_class, gpu_model, gpu_count, node_count, submit,
queue, start and end times, end_reason, guarantee_seconds and, if the run was evicted, trigger_id,
rollback_seconds and overhead_seconds. An eviction without a trigger is missing from the preemption
ledger, which then disagrees with the job counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import EPSILON
from ..functions import broadcast_if_small, exact_quantiles, rounded
from ..session import cut_lineage

RUN = ["run_id", "action_id"]


def run_seconds() -> Column:
    return F.col("end_time_seconds") - F.col("start_time_seconds")


def is_event() -> Column:
    return (F.col("end_reason") == "preempted") & F.col("trigger_id").isNotNull()


def job_ledger(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per job: first start, completion, waiting, preemptions, runs."""
    jobs = rows.groupBy(
        *RUN, "job_id", "service_class", "gpu_model", "gpu_count", "submit_time_seconds"
    ).agg(
        F.min("start_time_seconds").alias("start_time_seconds"),
        F.max(F.when(F.col("end_reason") == "completed", F.col("end_time_seconds"))).alias(
            "completion_time_seconds"
        ),
        F.sum(F.col("start_time_seconds") - F.col("queued_since")).alias("queue_seconds"),
        F.count_if(F.col("end_reason") == "preempted").alias("preemption_count"),
        F.count(F.lit(1)).alias("run_count"),
    )
    return evaluated_jobs(in_windows(jobs, runs))


def in_windows(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows with the evaluation window of their run; rows that have one already, as from a join before they multiplied, stay."""
    if "evaluation_start" in rows.columns:
        return rows
    return rows.join(broadcast_if_small(runs.select("run_id", "evaluation_start", "evaluation_end")), "run_id")


def evaluated_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with their completion time and whether they belong to their run's evaluation population."""
    return (
        jobs.withColumn(
            "evaluation_population",
            F.col("submit_time_seconds").between(F.col("evaluation_start"), F.col("evaluation_end")),
        )
        .withColumn("jct_seconds", F.col("completion_time_seconds") - F.col("submit_time_seconds"))
        .drop("evaluation_start", "evaluation_end")
    )


def preemption_ledger(rows: DataFrame) -> DataFrame:
    lost = F.col("rollback_seconds") + F.col("overhead_seconds")
    return rows.where(is_event()).select(
        *RUN,
        F.col("end_time_seconds").alias("time_seconds"),
        F.col("job_id").alias("preempted_job_id"),
        F.col("trigger_id").alias("triggering_job_id"),
        "rollback_seconds",
        "overhead_seconds",
        (lost * F.col("gpu_count")).alias("added_gpu_seconds"),
    )


def spot_run_ledger(rows: DataFrame) -> DataFrame:
    """Spot runs with whether each kept its guarantee."""
    kept = (F.col("end_reason") == "completed") | (
        run_seconds() + EPSILON >= F.col("guarantee_seconds")
    )
    return rows.where(F.col("service_class") == "Spot").select(
        *RUN,
        "job_id",
        "run_ordinal",
        "start_time_seconds",
        "end_time_seconds",
        "end_reason",
        run_seconds().alias("uninterrupted_seconds"),
        "guarantee_seconds",
        kept.alias("guarantee_succeeded"),
    )


def evaluated_spot(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Run rows of Spot jobs that arrived inside their run's evaluation window.

    A run row knows its job's arrival, so the windows come to the rows and nothing is shuffled.
    """
    windows = broadcast_if_small(runs.select("run_id", "evaluation_start", "evaluation_end"))
    arrived = F.col("submit_time_seconds").between(F.col("evaluation_start"), F.col("evaluation_end"))
    return rows.where(F.col("service_class") == "Spot").join(windows, "run_id").where(arrived)


def class_metrics(ledger: DataFrame, stored: bool = False) -> DataFrame:
    """JCT, queueing and preemption per (run, class) of the evaluation population.

    Both classes of a run appear; a class without jobs has counts of zero and no rates. ``stored`` says that the
    ledger is cheap to read several times. A row with ``jobs`` stands for so many equal ones.
    """
    ledger = ledger.select(
        *RUN,
        "service_class",
        "evaluation_population",
        "jct_seconds",
        "queue_seconds",
        "completion_time_seconds",
        "preemption_count",
        "run_count",
        (F.col("jobs") if "jobs" in ledger.columns else F.lit(1)).cast("long").alias("jobs"),
    )
    if not stored:
        # Written once: the population is read for its moments and twice for its ranks.
        ledger = cut_lineage(ledger)
    key = [*RUN, "service_class"]
    classes = F.array(F.lit("HP"), F.lit("Spot"))
    counted_in = F.col("evaluation_population")
    number = lambda c: F.sum(F.when(counted_in & c, F.col("jobs")))
    total = lambda c: F.sum(F.when(counted_in, F.col(c) * F.col("jobs")))
    mean = lambda c: total(c) / number(F.col(c).isNotNull())
    # A count of jobs without any stays null, so that it gives no rates; the others are parts of it and may be none.
    none = F.lit(0)
    totals = cut_lineage(
        ledger.groupBy(*key).agg(
            number(F.lit(True)).alias("job_count"),
            F.coalesce(number(F.col("completion_time_seconds").isNotNull()), none).alias("completed_count"),
            mean("jct_seconds").alias("jct_mean"),
            mean("queue_seconds").alias("queue_mean"),
            total("preemption_count").alias("preemption_count"),
            F.coalesce(number(F.col("preemption_count") > 0), none).alias("preempted_job_count"),
            total("run_count").alias("run_count"),
        )
    )
    domain = totals.select(*RUN).distinct().withColumn("service_class", F.explode(classes))
    scored = ledger.where("evaluation_population")
    shares = {"p50": 0.50, "p95": 0.95}
    values = scored.select(
        *key,
        "jobs",
        F.inline(
            F.array(
                *[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_seconds").alias("seconds")) for m in ("jct", "queue")]
            )
        ),
    )
    ranks = exact_quantiles(values, [*key, "measure"], "seconds", shares, weight="jobs")
    picked = lambda m, q: F.max(F.when(F.col("measure") == m, F.col(q))).alias(f"{m}_{q}")
    quantiles = ranks.groupBy(*key).agg(*[picked(m, q) for m in ("jct", "queue") for q in shares])
    measured = ("jct_mean", "jct_p50", "jct_p95", "queue_mean", "queue_p50", "queue_p95")
    counted = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        domain.join(totals, key, "left")
        .join(quantiles, key, "left")
        .select(
            *key,
            counted("job_count"),
            counted("completed_count"),
            rounded(F.col("completed_count") / F.col("job_count")).alias("completion_rate"),
            *[rounded(F.col(c)).alias(f"{c}_seconds") for c in measured],
            counted("preemption_count"),
            counted("preempted_job_count"),
            rounded(F.col("preempted_job_count") / F.col("job_count")).alias("preempted_job_rate"),
            counted("run_count"),
        )
    )


def _spot_sums(counted: Column) -> dict[str, Column]:
    """Sums over the run rows that are ``counted``, for ``_spot_columns``."""
    event, hit = is_event(), F.col("end_reason") == "preempted"
    kept = (F.col("end_reason") == "completed") | (run_seconds() + EPSILON >= F.col("guarantee_seconds"))
    lost = F.col("rollback_seconds") + F.col("overhead_seconds")
    inside = F.col("end_time_seconds") <= F.col("evaluation_end")
    summed = lambda c: F.coalesce(F.sum(F.when(counted & event, c)), F.lit(0.0))
    return {
        "spot_run_count": F.count_if(counted),
        "preemption_event_count": F.count_if(counted & event),
        "events_during_evaluation_window": F.count_if(counted & event & inside),
        "events_during_drain": F.count_if(counted & event & ~inside),
        "guarantee_succeeded_count": F.count_if(counted & kept),
        "unexplained_failure_count": F.count_if(counted & ~kept & ~hit),
        "rollback_seconds_total": rounded(summed(F.col("rollback_seconds"))),
        "overhead_seconds_total": rounded(summed(F.col("overhead_seconds"))),
        "added_gpu_seconds_total": rounded(summed(lost * F.col("gpu_count"))),
    }


def _spot_rates() -> dict[str, Column]:
    n = F.col("spot_run_count")
    return {
        "eviction_rate_per_run": F.when(n > 0, rounded(F.col("preemption_event_count") / n)),
        "guarantee_success_rate": F.when(n > 0, rounded(F.col("guarantee_succeeded_count") / n)),
    }


def spot_metrics(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Evictions, guarantees and lost work of evaluated Spot jobs, drain included."""
    sums = _spot_sums(F.lit(True))
    return evaluated_spot(rows, runs).groupBy(*RUN).agg(*[c.alias(n) for n, c in sums.items()]).withColumns(_spot_rates())


def _allocation_sums() -> dict[str, Column]:
    start, end = F.col("start_time_seconds"), F.col("end_time_seconds")
    lo, hi = F.col("evaluation_start"), F.col("evaluation_end")
    overlap = F.greatest(F.lit(0.0), F.least(end, hi) - F.greatest(start, lo))
    gpus = F.col("gpu_count")
    return {
        "total": F.sum(gpus * (end - start)),
        "warmup": F.sum(gpus * F.greatest(F.lit(0.0), F.least(end, lo) - start)),
        "inside": F.sum(gpus * overlap),
    }


def _allocation_rates(capacity: Column) -> dict[str, Column]:
    lo, hi = F.col("evaluation_start"), F.col("evaluation_end")
    return {
        "allocated_gpu_seconds": rounded(F.col("total"), 3),
        "warmup_allocated_gpu_seconds": rounded(F.col("warmup"), 3),
        "evaluation_allocated_gpu_seconds": rounded(F.col("inside"), 3),
        "drain_allocated_gpu_seconds": rounded(F.col("total") - F.col("warmup") - F.col("inside"), 3),
        "allocation_rate_mean": F.when(hi > lo, rounded(F.col("inside") / (capacity * (hi - lo)))).otherwise(0.0),
    }


def allocation(rows: DataFrame, runs: DataFrame, capacity: Column) -> DataFrame:
    """Allocated GPU-seconds split at the evaluation window, and the rate inside it."""
    windows = broadcast_if_small(runs.select("run_id", "evaluation_start", "evaluation_end"))
    sums = rows.join(windows, "run_id").groupBy(*RUN, "evaluation_start", "evaluation_end").agg(*[c.alias(n) for n, c in _allocation_sums().items()])
    return sums.select(*RUN, *[c.alias(n) for n, c in _allocation_rates(capacity).items()])


METRICS_SCHEMA = "policy-metrics/v1"
ALLOCATION = (
    "allocated_gpu_seconds",
    "warmup_allocated_gpu_seconds",
    "evaluation_allocated_gpu_seconds",
    "drain_allocated_gpu_seconds",
    "allocation_rate_mean",
)
LEDGER_COUNTS = ("preemption_event_count", "spot_run_count", "guarantee_failed_count", "unexplained_failure_count")


def metrics_report(
    rows: DataFrame, runs: DataFrame, capacity: Column, jobs: DataFrame | None = None, evidence: dict[str, Column] | None = None
) -> DataFrame:
    """One row per run with every catalogued metric and the ledgers' consistency, ready for audit and ranking.

    ``jobs`` is the job ledger where the caller has it without a shuffle; ``evidence`` are further aggregates over the
    run rows. Spot metrics, allocation and evidence come from one partial aggregate.
    """
    stored = jobs is not None
    by_class = cut_lineage(class_metrics(jobs if stored else job_ledger(rows, runs), stored))
    return joined_report(by_class, run_sums(rows, runs, capacity, evidence), evidence)


def run_sums(rows: DataFrame, runs: DataFrame, capacity: Column, evidence: dict[str, Column] | None = None) -> DataFrame:
    """Spot metrics, allocation and evidence of each run, from one partial aggregate over the run rows."""
    evaluated = (F.col("service_class") == "Spot") & F.col("submit_time_seconds").between(F.col("evaluation_start"), F.col("evaluation_end"))
    sums = {**_spot_sums(evaluated), **_allocation_sums(), **(evidence or {})}
    return (
        in_windows(rows, runs)
        .groupBy(*RUN, "evaluation_start", "evaluation_end")
        .agg(*[c.alias(n) for n, c in sums.items()])
        .withColumns({**_spot_rates(), **_allocation_rates(capacity)})
    )


def joined_report(by_class: DataFrame, over_runs: DataFrame, evidence: dict[str, Column] | None = None) -> DataFrame:
    """The report of ``class_metrics`` and ``run_sums``."""

    def side(name: str, prefix: str, columns: Sequence[str]) -> DataFrame:
        return by_class.where(F.col("service_class") == name).select(
            *RUN,
            F.col("job_count").alias(f"{prefix}_job_count"),
            F.col("completed_count").alias(f"{prefix}_completed_count"),
            F.col("completion_rate").alias(f"{prefix}_completion_rate"),
            *[F.col(f"{c}_seconds").alias(f"{prefix}_{c}_seconds") for c in columns],
            F.col("preemption_count").cast("double").alias(f"{prefix}_preemption_count"),
            F.col("preempted_job_count").cast("double").alias(f"{prefix}_preempted_job_count"),
            F.col("preempted_job_rate").alias(f"{prefix}_preempted_job_rate"),
            F.col("run_count").alias(f"{prefix}_runs_of_jobs"),
        )

    measured = ("jct_mean", "jct_p50", "jct_p95", "queue_mean", "queue_p95")
    found = F.col("spot_run_count") > 0
    spot = over_runs.select(
        *RUN,
        "evaluation_start",
        "evaluation_end",
        *ALLOCATION,
        F.col("eviction_rate_per_run").alias("spot_eviction_rate_per_run"),
        F.col("guarantee_success_rate").alias("spot_guarantee_success_rate"),
        F.when(found, F.col("added_gpu_seconds_total")).alias("preemption_added_gpu_seconds"),
        "preemption_event_count",
        "spot_run_count",
        (F.col("spot_run_count") - F.col("guarantee_succeeded_count")).alias("guarantee_failed_count"),
        "unexplained_failure_count",
        *(evidence or {}),
    )
    joined = spot.join(side("HP", "hp", measured), RUN).join(side("Spot", "spot", measured), RUN)
    counted = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.withColumns(
        {c: counted(c) for c in LEDGER_COUNTS}
    ).withColumns(
        {
            "schema_version": F.lit(METRICS_SCHEMA),
            "preemption_ledger_consistent": F.col("preemption_event_count") == F.col("spot_preemption_count"),
            "run_ledger_consistent": F.col("spot_run_count") == F.col("spot_runs_of_jobs"),
            "guarantee_ledger_consistent": (F.col("guarantee_failed_count") <= F.col("preemption_event_count"))
            & (F.col("unexplained_failure_count") == 0),
            "scheduler": F.when(F.col("action_id").contains("fifo"), "fifo").otherwise("priority_preemptive"),
        }
    )


def feedback_events(rows: DataFrame) -> DataFrame:
    """Guarantee feedback: every full guarantee period, every completion, every eviction.

    An event weighs as many nodes as the run held.
    """
    spot = rows.where((F.col("service_class") == "Spot") & F.col("guarantee_seconds").isNotNull())
    guarantee = F.col("guarantee_seconds")
    periods = F.when(
        guarantee > 0, F.floor((run_seconds() + EPSILON) / guarantee).cast("int")
    ).otherwise(0)
    kept = F.struct(F.lit("guarantee_duration_completed").alias("event_kind"), periods.alias("events"))
    ended = F.struct(
        F.when(F.col("end_reason") == "preempted", "preempted").otherwise("job_completed").alias("event_kind"),
        F.lit(1).alias("events"),
    )
    return (
        spot.select(*RUN, "gpu_model", "node_count", F.inline(F.array(kept, ended)))
        .where("events > 0")
        .groupBy(*RUN, "gpu_model", "event_kind")
        .agg(
            F.sum("events").cast("long").alias("event_count"),
            F.sum(F.col("events") * F.col("node_count")).cast("double").alias("weight"),
        )
    )
