"""Evidence-backed comparison of two policies, and of a bounded portfolio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import POLICIES
from ..functions import rounded
from .audit import METRIC_CATALOG, metric_map
from .metrics import METRICS_SCHEMA

MIN_PORTFOLIO, MAX_PORTFOLIO = 3, 5


# Controls two compared policies must share.
EXECUTION_CONTROLS = ("preemption_overhead_seconds", "placement_strategy", "predictive_admission_mode")


def _execution_controls(action: Column) -> Column:
    entries = [
        x
        for p in POLICIES.values()
        for x in (F.lit(p.action_id), F.lit("|".join(str(getattr(p, c)) for c in EXECUTION_CONTROLS)))
    ]
    return F.element_at(F.create_map(*entries), action)


# What a report must have, and what two reports must share, to be compared.
AVAILABLE = {
    "event_ledgers_available": "preemption_event_count",
    "run_ledgers_available": "spot_run_count",
    "guarantee_ledgers_available": "guarantee_failed_count",
}
CONSISTENT = {
    "event_ledgers_consistent": "preemption_ledger_consistent",
    "run_ledgers_consistent": "run_ledger_consistent",
    "guarantee_ledgers_consistent": "guarantee_ledger_consistent",
}
SHARED = {
    "source_match": ("source",),
    "trace_id_match": ("trace_id",),
    "window_match": ("evaluation_start", "evaluation_end"),
    "population_match": ("hp_job_count", "spot_job_count"),
}


def own_criteria() -> dict[str, Column]:
    """Criteria that each report meets or not by itself."""
    complete = (F.col("hp_completed_count") == F.col("hp_job_count")) & (
        F.col("spot_completed_count") == F.col("spot_job_count")
    )
    own = {
        "metrics_schema_supported": F.col("schema_version") == METRICS_SCHEMA,
        "metrics_fingerprints_valid": F.col("evidence_valid"),
        "populations_complete": complete,
        **{n: F.col(c).isNotNull() for n, c in AVAILABLE.items()},
        **{n: F.col(c) for n, c in CONSISTENT.items()},
    }
    return {n: F.coalesce(c, F.lit(False)) for n, c in own.items()}


def shared_facts() -> dict[str, Column]:
    """What all compared reports must agree on, one value per criterion."""
    facts = {n: F.to_json(F.struct(*columns)) for n, columns in SHARED.items()}
    return {**facts, "execution_controls_match": _execution_controls(F.col("action_id"))}


def group_criteria(metrics: DataFrame, keys: Sequence[str], distinct: str) -> DataFrame:
    """Per group, every criterion over all its reports, and ``comparable``: all of them hold."""
    own, shared = own_criteria(), shared_facts()
    facts = metrics.select(
        *keys, "action_id", *[c.alias(f"_o_{n}") for n, c in own.items()], *[c.alias(f"_s_{n}") for n, c in shared.items()]
    )
    judged = facts.groupBy(*keys).agg(
        *[F.bool_and(f"_o_{n}").alias(n) for n in own],
        *[(F.min(f"_s_{n}").eqNullSafe(F.max(f"_s_{n}")) & F.min(F.col(f"_s_{n}").isNotNull())).alias(n) for n in shared],
        (F.count("*") == F.count_distinct("action_id")).alias(distinct),
        F.count("*").alias("candidate_count"),
    )
    every = F.lit(True)
    for name in (*own, *shared, distinct):
        every = every & F.col(name)
    return judged.withColumn("comparable", every)


def _delta_rows(left: str, right: str) -> Column:
    """Right minus left, absolute and relative to left; null where either side is missing."""
    rows = []
    for name, (_, direction) in METRIC_CATALOG.items():
        a, b = F.col(f"{left}._m")[name], F.col(f"{right}._m")[name]
        absolute = rounded(b - a)
        rows.append(
            F.struct(
                F.lit(name).alias("metric"),
                a.alias("left_value"),
                b.alias("right_value"),
                absolute.alias("right_minus_left"),
                F.when(a != 0, rounded(absolute / a)).alias("relative_to_left"),
                F.lit(direction).alias("preferred_direction"),
            )
        )
    return F.array(*rows)


def portfolio_criteria(metrics: DataFrame, order: Sequence[str], window: Sequence[str] = ("window_id",)) -> DataFrame:
    """The criteria of each window's portfolio; one of another size, or with an undeclared action, is an error."""
    declared = F.col("action_id").isin(*order)
    checked = metrics.withColumn(
        "action_id",
        F.when(declared, F.col("action_id")).otherwise(F.raise_error(F.lit("undeclared action in a portfolio")).cast("string")),
    )
    judged = group_criteria(checked, window, "policy_actions_unique")
    fits = F.col("candidate_count").between(MIN_PORTFOLIO, MAX_PORTFOLIO)
    bounded = F.when(fits, F.lit(True)).otherwise(
        F.raise_error(F.lit("a portfolio needs between 3 and 5 candidates")).cast("boolean")
    )
    return judged.withColumn("candidate_count_between_3_and_5", bounded).withColumn(
        "comparable", F.col("comparable") & bounded
    )


def pairwise_deltas(
    metrics: DataFrame, order: Sequence[str], window: Sequence[str] = ("window_id",)
) -> DataFrame:
    """Deltas of every unordered pair of a window's three to five declared candidates, at most ten pairs."""
    position = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("action_id"))
    ranked = metrics.withColumn("_i", position).withColumn("_m", metric_map(metrics))
    verdicts = portfolio_criteria(metrics, order, window).select(*window, "comparable")
    left, right = ranked.alias("l"), ranked.join(verdicts, list(window)).alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in window] + [F.col("l._i") < F.col("r._i")]
    return left.join(right, on).select(
        *[F.col(f"l.{c}").alias(c) for c in window],
        F.col("l.action_id").alias("left_action_id"),
        F.col("r.action_id").alias("right_action_id"),
        F.col("r.comparable").alias("comparable"),
        F.inline(_delta_rows("l", "r")),
    )


def compare_two(metrics: DataFrame, left_action: str, right_action: str) -> DataFrame:
    """The deltas and criteria of one declared pair of actions in every window that has both."""
    mapped = metrics.withColumn("_m", metric_map(metrics))
    pair = metrics.where(F.col("action_id").isin(left_action, right_action))
    criteria = group_criteria(pair, ["window_id"], "policy_actions_distinct").where("candidate_count = 2").alias("c")
    left = mapped.where(F.col("action_id") == left_action).alias("l")
    right = mapped.where(F.col("action_id") == right_action).alias("r")
    names = [*own_criteria(), *shared_facts(), "policy_actions_distinct", "comparable"]
    same = lambda side: F.col("l.window_id") == F.col(f"{side}.window_id")
    return left.join(right, same("r")).join(criteria, same("c")).select(
        F.col("l.window_id").alias("window_id"), *[F.col(f"c.{n}").alias(n) for n in names], F.inline(_delta_rows("l", "r"))
    )
