"""SLO constraints and their audit against metrics rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import EPSILON

# Metric names, their path in a metrics report and the preferred direction.
METRIC_CATALOG: dict[str, tuple[str, str]] = {
    "hp_completion_rate": ("jobs.HP.completion_rate", "higher_is_better"),
    "hp_jct_mean_seconds": ("jobs.HP.jct_seconds.mean", "lower_is_better"),
    "hp_jct_p50_seconds": ("jobs.HP.jct_seconds.p50", "lower_is_better"),
    "hp_jct_p95_seconds": ("jobs.HP.jct_seconds.p95", "lower_is_better"),
    "hp_queue_mean_seconds": ("jobs.HP.queue_seconds.mean", "lower_is_better"),
    "hp_queue_p95_seconds": ("jobs.HP.queue_seconds.p95", "lower_is_better"),
    "hp_preempted_job_count": ("jobs.HP.preempted_job_count", "lower_is_better"),
    "spot_completion_rate": ("jobs.Spot.completion_rate", "higher_is_better"),
    "spot_jct_mean_seconds": ("jobs.Spot.jct_seconds.mean", "lower_is_better"),
    "spot_jct_p50_seconds": ("jobs.Spot.jct_seconds.p50", "lower_is_better"),
    "spot_jct_p95_seconds": ("jobs.Spot.jct_seconds.p95", "lower_is_better"),
    "spot_queue_mean_seconds": ("jobs.Spot.queue_seconds.mean", "lower_is_better"),
    "spot_queue_p95_seconds": ("jobs.Spot.queue_seconds.p95", "lower_is_better"),
    "spot_preemption_count": ("jobs.Spot.preemption_count", "lower_is_better"),
    "spot_preempted_job_rate": ("jobs.Spot.preempted_job_rate", "lower_is_better"),
    "spot_eviction_rate_per_run": ("preemption_events.eviction_rate_per_run", "lower_is_better"),
    "spot_guarantee_success_rate": ("spot_guarantee.success_rate", "higher_is_better"),
    "allocation_rate_mean": ("cluster.allocation_rate_mean", "higher_is_better"),
    "preemption_added_gpu_seconds": (
        "preemption_events.added_gpu_seconds_total",
        "lower_is_better",
    ),
}


@dataclass(frozen=True)
class Constraint:
    id: str
    metric: str
    operator: str
    severity: str = "hard"
    threshold: float | None = None
    baseline_metric: str | None = None
    multiplier: float = 1.0
    addend: float = 0.0


# The demonstration SLO.
DEMO_SLO: tuple[Constraint, ...] = (
    Constraint("hp-completion-rate", "hp_completion_rate", ">=", threshold=1.0),
    Constraint("hp-preempted-job-count", "hp_preempted_job_count", "<=", threshold=0.0),
    Constraint(
        "hp-p95-jct-fifo-regression",
        "hp_jct_p95_seconds",
        "<=",
        baseline_metric="hp_jct_p95_seconds",
        multiplier=1.01,
    ),
    Constraint("hp-p95-queue-seconds", "hp_queue_p95_seconds", "<=", threshold=3600.0),
    Constraint("spot-completion-rate", "spot_completion_rate", ">=", threshold=1.0),
    Constraint("spot-eviction-rate-per-run", "spot_eviction_rate_per_run", "<=", threshold=0.1),
    Constraint("spot-guarantee-success-rate", "spot_guarantee_success_rate", ">=", threshold=0.9),
    Constraint(
        "allocation-fifo-nondegradation",
        "allocation_rate_mean",
        ">=",
        baseline_metric="allocation_rate_mean",
    ),
    Constraint("allocation-soft-target", "allocation_rate_mean", ">=", "soft", threshold=0.8),
)
ALLOCATION_TIE_BAND = 0.01
# Hard constraints a cutoff scenario can already judge.
PROSPECTIVE_CONSTRAINTS = (
    "hp-completion-rate",
    "hp-preempted-job-count",
    "hp-p95-queue-seconds",
    "spot-completion-rate",
    "spot-eviction-rate-per-run",
    "spot-guarantee-success-rate",
)


#: Flags of a report that every audit asks for.
EVIDENCE = (
    "evidence_valid",
    "preemption_ledger_consistent",
    "run_ledger_consistent",
    "guarantee_ledger_consistent",
)
#: What a baseline must share with the audited report.
SHARED = ("source", "trace_id", "evaluation_start", "evaluation_end", "hp_job_count", "spot_job_count")


def check_slo(constraints: Sequence[Constraint]) -> None:
    ids = [c.id for c in constraints]
    if not ids or len(set(ids)) != len(ids):
        raise ValueError("Constraint ids must exist and be unique")
    for c in constraints:
        known = {c.metric} | ({c.baseline_metric} if c.baseline_metric else set())
        if not known <= set(METRIC_CATALOG):
            raise ValueError(f"{c.id}: unsupported metric")
        if c.operator not in ("<", "<=", ">", ">=") or c.severity not in ("hard", "soft"):
            raise ValueError(f"{c.id}: unsupported operator or severity")
        if (c.threshold is None) == (c.baseline_metric is None):
            raise ValueError(f"{c.id}: give either an absolute or a baseline-relative threshold")


def metric_map(df: DataFrame) -> Column:
    names = [m for m in METRIC_CATALOG if m in df.columns]
    return F.create_map(
        *[x for m in names for x in (F.lit(m), F.col(m).cast("double"))]
    )


def report_metrics(reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Project the catalog out of nested metrics reports, one row per metric."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(path).cast("double").alias("value"),
                F.lit(direction).alias("preferred_direction"),
            )
            for name, (path, direction) in METRIC_CATALOG.items()
        ]
    )
    return reports.select(*keys, F.inline(rows))


def _compare(operator: Column, observed: Column, threshold: Column) -> Column:
    return (
        F.when(operator == "<", observed < threshold)
        .when(operator == "<=", observed <= threshold)
        .when(operator == ">", observed > threshold)
        .when(operator == ">=", observed >= threshold)
    )


def audit_constraints(
    metrics: DataFrame,
    window: Sequence[str],
    action: str = "action_id",
    baseline_action: str = "native-fifo",
    constraints: Sequence[Constraint] = DEMO_SLO,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every (window, action, constraint) with what was observed and how it was judged.

    A baseline counts only when it ran FIFO over the same source, trace, window and population and its
    own evidence is valid; otherwise the relative thresholds are unavailable, which is not a pass.
    """
    check_slo(constraints)
    spec = F.array(
        *[
            F.struct(
                F.lit(c.id).alias("constraint_id"),
                F.lit(c.metric).alias("metric"),
                F.lit(c.operator).alias("operator"),
                F.lit(c.severity).alias("severity"),
                F.lit(c.threshold).cast("double").alias("absolute"),
                F.lit(c.baseline_metric).cast("string").alias("baseline_metric"),
                F.lit(c.multiplier).alias("multiplier"),
                F.lit(c.addend).alias("addend"),
            )
            for c in constraints
        ]
    )
    peers = Window.partitionBy(*window)
    baseline = F.first(
        F.when(
            F.col(action) == baseline_action,
            F.struct(metric_map(metrics).alias("metrics"), *SHARED, "scheduler", "evidence_valid"),
        ),
        ignorenulls=True,
    ).over(peers)
    joined = metrics.withColumn("_m", metric_map(metrics)).withColumn("_b", baseline)
    usable = (F.col("_b.scheduler") == "fifo") & F.col("_b.evidence_valid")
    for name in SHARED:
        usable = usable & F.col(f"_b.{name}").eqNullSafe(F.col(name))
    compatible = F.coalesce(usable, F.lit(False))
    rows = joined.select(
        *window,
        action,
        *carry,
        "hp_job_count",
        "spot_job_count",
        compatible.alias("baseline_compatible"),
        "_m",
        "_b",
        F.inline(spec),
    )
    threshold = F.when(F.col("baseline_metric").isNull(), F.col("absolute")).when(
        F.col("baseline_compatible"),
        F.col("_b.metrics")[F.col("baseline_metric")] * F.col("multiplier") + F.col("addend"),
    )
    judged = rows.withColumn("observed", F.col("_m")[F.col("metric")]).withColumn(
        "threshold", threshold
    )
    passed = F.coalesce(
        _compare(F.col("operator"), F.col("observed"), F.col("threshold")), F.lit(False)
    )
    unavailable = F.col("observed").isNull() | F.col("threshold").isNull()
    return judged.withColumn("passed", passed).select(
        *window,
        action,
        *carry,
        "hp_job_count",
        "spot_job_count",
        "baseline_compatible",
        "constraint_id",
        "metric",
        "severity",
        "observed",
        "threshold",
        F.when(F.col("passed"), "passed")
        .when(unavailable, "unavailable")
        .otherwise("failed")
        .alias("status"),
        "passed",
    )


def relax_for_candidates(audited: DataFrame) -> DataFrame:
    """Cutoff scope: empty populations are vacuous and end-of-window constraints wait."""
    prefix = F.substring_index("metric", "_", 1)
    empty = ((prefix == "hp") & (F.col("hp_job_count") == 0)) | (
        (prefix == "spot") & (F.col("spot_job_count") == 0)
    )
    vacuous = (F.col("status") == "unavailable") & empty
    waits = (F.col("severity") == "hard") & ~F.col("constraint_id").isin(*PROSPECTIVE_CONSTRAINTS)
    return audited.withColumns(
        {
            "status": F.when(vacuous, "not_applicable_zero_population")
            .when(waits, "final_window_only")
            .otherwise(F.col("status")),
            "passed": F.col("passed") | vacuous | waits,
        }
    )


def audit_summary(
    audited: DataFrame, keys: Sequence[str], constraints: Sequence[Constraint] = DEMO_SLO
) -> DataFrame:
    """One verdict per candidate: every hard constraint, a usable baseline, valid and consistent evidence.

    ``audited`` must carry the columns of ``EVIDENCE``; a null flag is not a pass.
    """
    hard = F.col("severity") == "hard"
    baseline_needed = any(c.baseline_metric for c in constraints)
    verdict = F.bool_and(F.col("passed") | ~hard)
    if baseline_needed:
        verdict = verdict & F.bool_and("baseline_compatible")
    for flag in EVIDENCE:
        verdict = verdict & F.bool_and(F.coalesce(flag, F.lit(False)))
    failed = F.array_sort(F.collect_list(F.when(hard & ~F.col("passed"), F.col("constraint_id"))))
    return audited.groupBy(*keys).agg(
        verdict.alias("audit_passed"),
        F.count_if(hard).alias("hard_constraint_count"),
        F.count_if(~hard & ~F.col("passed")).alias("soft_violation_count"),
        failed.alias("failed_hard_constraints"),
    )


# What a metric snapshot shows.
SNAPSHOT = (
    "allocation_rate_mean",
    "hp_completion_rate",
    "hp_preempted_job_count",
    "hp_jct_p95_seconds",
    "hp_queue_p95_seconds",
    "spot_completion_rate",
    "spot_jct_p95_seconds",
    "spot_eviction_rate_per_run",
    "spot_guarantee_success_rate",
)


def metric_snapshot(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the declared audit and ranking metrics of each report."""
    return metrics.select(*keys, *SNAPSHOT)


def queue_guard(p95: Column, threshold: float) -> Column:
    """The projected HP queue p95 stays within its limit; no HP at all passes."""
    return p95.isNull() | (p95 <= threshold + EPSILON)
