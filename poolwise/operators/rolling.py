"""Rolling decisions: cutoff signals, candidate choice, scenarios and robust evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import EPSILON, HOUR, POLICIES, ROLLING_ACTIONS, Trace
from ..functions import asof_lookup, global_value_ranks, ratio_or_default, rounded
from ..session import cut_lineage
from .audit import queue_guard
from .profile import active_by_class
from .slicing import total_capacity

QUEUE_P95_LIMIT = 3600.0


def robust_candidates(
    evidence: DataFrame, decision: Sequence[str], queue_limit: float = QUEUE_P95_LIMIT
) -> DataFrame:
    """Fold scenario evidence into one row per candidate.

    A candidate must pass, with its queue guard, in every decision scenario; its allocation is the
    worst of them and so are its latencies. Stress scenarios are only counted.
    """
    role = F.col("selection_role")
    deciding, stress = role == "decision", role == "stress"
    ok = F.col("hard_slo_passed") & queue_guard(F.col("projected_hp_queue_p95"), queue_limit)
    only = lambda c: F.when(deciding, F.col(c))
    worst = (
        "hp_jct_p95_seconds",
        "hp_queue_p95_seconds",
        "spot_jct_p95_seconds",
        "spot_eviction_rate_per_run",
    )
    return evidence.groupBy(*decision, "action_id").agg(
        F.bool_and(ok | ~deciding).alias("hard_slo_passed"),
        F.count_if(stress & ok).alias("stress_scenario_pass_count"),
        F.count_if(stress).alias("stress_scenario_count"),
        F.min(only("allocation_rate_mean")).alias("allocation_rate_mean"),
        *[F.max(only(c)).alias(c) for c in worst],
    )


def window_signals(
    trace: Trace,
    *,
    interval: float,
    history: float,
    decisions: Column,
    shift: float = 0.0,
) -> DataFrame:
    """Workload signals of the window ``(cutoff - history, cutoff]`` for every cutoff.

    Cutoffs are ``k * interval - shift`` for ``k = 1 .. decisions``. A job belongs to the few
    cutoffs whose window holds its arrival, and only those arrivals count as active.
    """
    submit = F.col("submit_time_seconds")
    moved = submit + shift
    first = F.greatest(F.lit(1), F.ceil((moved - EPSILON) / interval)).cast("long")
    last = F.least(decisions, F.ceil((moved + history) / interval) - 1).cast("long")
    start = F.col("decision") * interval - shift - history
    placed = (
        trace.jobs.withColumns({"_first": first, "_last": last})
        .where("_first <= _last")
        .select(
            "submit_time_seconds",
            "duration_seconds",
            "gpu_count",
            "service_class",
            F.explode(F.sequence("_first", "_last")).alias("decision"),
        )
    )
    of = lambda cls, v: F.sum(F.when(F.col("service_class") == cls, v).otherwise(0.0))
    hp = F.col("service_class") == "HP"
    totals = placed.groupBy("decision").agg(
        F.count(F.lit(1)).alias("observed_job_count"),
        F.count_if(hp).alias("hp_job_count"),
        F.count_if(~hp).alias("spot_job_count"),
        of("HP", F.col("gpu_count")).alias("hp"),
        of("Spot", F.col("gpu_count")).alias("spot"),
        of("HP", F.when(submit <= start + history / 2, F.col("gpu_count")).otherwise(0.0)).alias("prior"),
        F.max(submit).alias("last_submit"),
    )
    samples = int(history // HOUR)
    clip = lambda c: F.greatest(F.lit(0), F.least(c, F.lit(samples + 1))).cast("long")
    enters = F.ceil((submit - start) / HOUR)
    leaves = F.ceil((submit + F.col("duration_seconds") - start) / HOUR)
    deltas = (
        placed.where(hp)
        .select(
            "decision",
            F.inline(
                F.array(
                    F.struct(clip(enters).alias("tick"), F.col("gpu_count").alias("delta")),
                    F.struct(clip(leaves).alias("tick"), (-F.col("gpu_count")).alias("delta")),
                )
            ),
        )
        .groupBy("decision", "tick")
        .agg(F.sum("delta").alias("delta"))
    )
    cutoffs = trace.jobs.sparkSession.range(1).select(
        F.explode(
            F.when(decisions >= 1, F.sequence(F.lit(1).cast("long"), decisions)).otherwise(F.array())
        ).alias("decision")
    )
    ticks = F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(samples).cast("long"))
    ).alias("tick")
    run = Window.partitionBy("decision").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    active = (
        cutoffs.select("decision", ticks)
        .join(deltas, ["decision", "tick"], "left")
        .withColumn("active", F.sum(F.coalesce("delta", F.lit(0.0))).over(run))
        .groupBy("decision")
        .agg(F.max("active").alias("peak"), F.stddev_pop("active").alias("volatility"))
    )
    none = lambda c: F.coalesce(c, F.lit(0.0))
    hp_total, spot_total, prior = none("hp"), none("spot"), none("prior")
    total = hp_total + spot_total
    capacity = total_capacity(trace.nodes)
    return (
        cutoffs.join(totals, "decision", "left")
        .join(active, "decision")
        .select(
            "decision",
            (F.col("decision") * interval - shift).alias("cutoff_seconds"),
            *[
                F.coalesce(c, F.lit(0)).cast("long").alias(c)
                for c in ("observed_job_count", "hp_job_count", "spot_job_count")
            ],
            rounded(hp_total).alias("hp_requested_gpus"),
            rounded(spot_total).alias("spot_requested_gpus"),
            F.when(total > 0, rounded(spot_total / total, 9))
            .otherwise(0.0)
            .alias("spot_requested_gpu_share"),
            rounded(F.col("peak")).alias("hp_peak_active_gpus"),
            rounded(F.col("peak") / capacity, 9).alias("hp_peak_active_pressure"),
            rounded(F.col("volatility")).alias("hp_active_volatility_gpus"),
            ratio_or_default(hp_total - prior, prior).alias("hp_recent_to_prior_ratio"),
            F.col("last_submit").alias("maximum_observed_submit_time_seconds"),
        )
    )


def occupancy_snapshot(trace: Trace, *, interval: float, decisions: Column) -> DataFrame:
    """Scheduler state at each cutoff as plain occupancy implies it."""
    capacity = total_capacity(trace.nodes)
    active = active_by_class(
        trace.jobs, F.lit(0.0), decisions.cast("double") * interval, interval
    ).where("tick >= 1")
    of = lambda c: F.sum(F.when(F.col("service_class") == c, F.col("active_gpus")).otherwise(0.0))
    busy = active.groupBy(F.col("tick").alias("decision")).agg(
        of("HP").alias("hp"), of("Spot").alias("spot")
    )
    demand = F.col("hp") + F.col("spot")
    hp_runs = F.least(F.col("hp"), capacity)
    return busy.select(
        "decision",
        capacity.alias("capacity_gpus"),
        F.greatest(F.lit(0.0), capacity - demand).alias("free_gpus"),
        F.least(F.col("spot"), capacity - hp_runs).alias("running_spot_gpus"),
        F.when(F.col("hp") > capacity, 1).otherwise(0).cast("long").alias("queued_hp_job_count"),
        F.greatest(F.lit(0.0), demand - capacity).alias("queued_requested_gpus"),
    )


def multi_timescale(
    short: DataFrame, previous: DataFrame, long: DataFrame, snapshot: DataFrame, forecast: DataFrame
) -> DataFrame:
    """Slow and fast views of each cutoff, and the risk and regime they imply.

    ``forecast`` carries the peak calibrated and raw guarantee quantiles per decision.
    """
    pick = lambda df, tag: df.select(
        "decision",
        *[
            F.col(c).alias(f"{tag}_{c}")
            for c in ("hp_requested_gpus", "spot_requested_gpus", "spot_requested_gpu_share")
        ],
    )
    joined = (
        pick(short, "short")
        .join(pick(previous, "previous"), "decision")
        .join(long, "decision")
        .join(snapshot, "decision")
        .join(forecast, "decision", "left")
    )
    capacity = F.col("capacity_gpus")
    running_hp = F.greatest(
        F.lit(0.0), capacity - F.col("free_gpus") - F.col("running_spot_gpus")
    )
    calibrated = F.coalesce("peak_guarantee_gpus", F.lit(0.0)) / capacity
    raw = F.coalesce("peak_raw_guarantee_gpus", F.lit(0.0)) / capacity
    growth = ratio_or_default(
        F.col("short_hp_requested_gpus"), F.col("previous_hp_requested_gpus"), EPSILON
    )
    both = lambda tag: F.col(f"{tag}_hp_requested_gpus") + F.col(f"{tag}_spot_requested_gpus")
    pressure = running_hp / capacity
    queued = F.col("queued_hp_job_count") > 0
    # The declared risk and regime thresholds.
    high = queued | (pressure >= 0.8) | (calibrated >= 0.9) | (raw >= 1.0) | (growth >= 1.5)
    moderate = (pressure >= 0.6) | (calibrated >= 0.75) | (raw >= 0.9) | (growth >= 1.2)
    return joined.select(
        "decision",
        "cutoff_seconds",
        growth.alias("hp_ratio_short_vs_previous"),
        ratio_or_default(both("short"), both("previous"), EPSILON).alias(
            "total_ratio_short_vs_previous"
        ),
        rounded(F.col("short_spot_requested_gpu_share") - F.col("spot_requested_gpu_share"), 9).alias(
            "spot_share_delta_short_vs_long"
        ),
        rounded(F.col("free_gpus") / capacity, 9).alias("free_gpu_rate"),
        rounded(running_hp).alias("running_hp_gpus"),
        rounded(pressure, 9).alias("running_hp_pressure"),
        rounded(F.col("running_spot_gpus") / capacity, 9).alias("running_spot_pressure"),
        "queued_hp_job_count",
        rounded(calibrated, 9).alias("peak_calibrated_pressure"),
        rounded(raw, 9).alias("peak_raw_pressure"),
        F.when(high, "high").when(moderate, "moderate").otherwise("low").alias("risk_level"),
        F.when(queued | (pressure >= 0.8), "hp-constrained")
        .when((raw >= 1.0) | (calibrated >= 0.9), "forecast-constrained")
        .when(F.col("short_spot_requested_gpu_share") >= 0.55, "spot-heavy")
        .otherwise("balanced")
        .alias("workload_regime"),
        "hp_peak_active_pressure",
        "spot_requested_gpu_share",
        "hp_recent_to_prior_ratio",
    )


# The controls that name a kind of action.
KINDS = {
    "fifo, guarded": {"preemptive": False, "open": False},
    "prompt, guarded": {"preemptive": True, "delayed": False, "open": False},
    "prompt, open": {"preemptive": True, "delayed": False, "open": True, "victim": "longest_remaining"},
    "delayed, open": {"preemptive": True, "delayed": True, "open": True},
    "sparing, open": {"preemptive": True, "delayed": False, "open": True, "victim": "lowest_checkpoint_loss"},
}
# Per reason, the places after the baseline and the kinds that may take each, best first.
RULE_PLACES = {
    "high-hp-or-forecast-risk": (("prompt, open",), ("sparing, open", "prompt, guarded")),
    "spot-heavy-history": (("prompt, open",), ("delayed, open", "fifo, guarded")),
    "balanced-or-low-pressure-history": (("fifo, guarded",), ("prompt, open",)),
}


def catalog_controls(spark: SparkSession, catalog: Sequence[str]) -> DataFrame:
    """One row per catalogued action with the controls that the rule looks at."""
    rows = [
        (p.action_id, i, p.preemptive, p.hp_preemption_delay_seconds > 0, p.predictive_admission_mode == "bypass", p.preemption_victim_strategy)
        for i, p in enumerate(POLICIES[a] for a in catalog)
    ]
    return spark.createDataFrame(
        rows, "action_id string, place int, preemptive boolean, delayed boolean, open boolean, victim string"
    )


def rule_candidate_sets(
    spark: SparkSession, catalog: Sequence[str], baseline_action: str, budget: int = 3
) -> DataFrame:
    """Per reason, the baseline and the best other actions: reason_code, candidate_action_ids.

    A place goes to the catalog's first action of its best kind that the catalog has. Places left over go to
    the kinds in their declared order, then to any action by name. All tables are declared enumerations.
    """
    if baseline_action not in catalog or len(set(catalog)) < budget:
        raise ValueError("The catalog cannot form a bounded candidate set with its baseline")
    wanted = []
    for reason, places in RULE_PLACES.items():
        filled = [*places, *[(kind,) for kind in KINDS]]
        for place, kinds in enumerate(filled, 1):
            for choice, kind in enumerate(kinds):
                w = KINDS[kind]
                wanted.append((reason, place, choice, w["preemptive"], w.get("delayed"), w["open"], w.get("victim")))
    rules = spark.createDataFrame(
        wanted, "reason_code string, rank int, choice int, w_preemptive boolean, w_delayed boolean, w_open boolean, w_victim string"
    )
    controls = catalog_controls(spark, catalog)
    fits = F.lit(True)
    for name in ("preemptive", "delayed", "open", "victim"):
        fits = fits & F.coalesce(F.col(f"w_{name}") == F.col(name), F.lit(True))
    placed = F.broadcast(rules).join(controls, fits).groupBy("reason_code", "rank").agg(
        F.min_by("action_id", F.struct("choice", "place")).alias("action_id")
    )
    last = F.when(F.col("action_id") == baseline_action, 0).otherwise(len(KINDS) + 10)
    others = rules.select("reason_code").distinct().crossJoin(controls.select("action_id", last.alias("rank")))
    best = placed.unionByName(others).groupBy("reason_code", "action_id").agg(F.min("rank").alias("rank"))
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("rank", "action_id"))), 1, budget)
    return best.groupBy("reason_code").agg(ordered.getField("action_id").alias("candidate_action_ids"))


def rule_candidates(
    state: DataFrame, catalog: Sequence[str] = ROLLING_ACTIONS, baseline_action: str = "rolling-fifo-open"
) -> DataFrame:
    """The candidate set of every cutoff, from its risk, pressure, trend and Spot share."""
    sets = rule_candidate_sets(state.sparkSession, catalog, baseline_action)
    # The declared rule thresholds.
    risky = (
        (F.col("risk_level") == "high")
        | (F.col("queued_hp_job_count") > 0)
        | (F.col("hp_peak_active_pressure") >= 0.85)
        | (F.col("hp_recent_to_prior_ratio") >= 1.25)
    )
    reason = (
        F.when(risky, "high-hp-or-forecast-risk")
        .when(F.col("spot_requested_gpu_share") >= 0.55, "spot-heavy-history")
        .otherwise("balanced-or-low-pressure-history")
    )
    judged = state.select("decision", "cutoff_seconds", reason.alias("reason_code"))
    return judged.join(F.broadcast(sets), "reason_code", "left")


ALL_POOLS = "<all>"


def survival_estimates(
    completed: DataFrame, carryover: DataFrame, horizon_seconds: float, by: Sequence[str] = ()
) -> DataFrame:
    """Remaining runtime of each carry-over job from completed jobs it has not yet outlived.

    The median of ``duration - elapsed`` over completed jobs of its class and pool that ran longer
    than it has; the class stands in for an unseen pool. Two as-of lookups over ranked durations
    find the survivors' middle, so no job is paired with the samples.
    """
    samples = completed.select(
        *by,
        "service_class",
        F.explode(F.array(F.col("gpu_model"), F.lit(ALL_POOLS))).alias("sample_pool"),
        "duration_seconds",
    )
    key = [*by, "service_class", "sample_pool"]
    # Read five times below, so it is written once.
    ranks = cut_lineage(
        global_value_ranks(samples, key, "duration_seconds").withColumn(
            "upto", F.col("rows_before") + F.col("value_count")
        )
    )
    known = ranks.groupBy(*key).agg(F.max("group_rows").alias("samples"))
    pools = known.where(F.col("sample_pool") != ALL_POOLS)
    own = pools.select(
        *by, "service_class", F.col("sample_pool").alias("gpu_model"), F.col("samples").alias("own_samples")
    )
    whole = known.where(F.col("sample_pool") == ALL_POOLS).select(
        *by, "service_class", F.col("samples").alias("class_samples")
    )
    items = cut_lineage(
        carryover.join(own, [*by, "service_class", "gpu_model"], "left")
        .join(whole, [*by, "service_class"], "left")
        .withColumns(
            {
                "sample_pool": F.when(F.col("own_samples").isNotNull(), F.col("gpu_model")).otherwise(
                    ALL_POOLS
                ),
                "samples": F.coalesce("own_samples", "class_samples", F.lit(0)).cast("long"),
            }
        )
        .drop("own_samples", "class_samples")
    )
    probes = items.where("samples > 0").select(
        *key, "job_id", "samples", F.col("elapsed_seconds").alias("duration_seconds")
    )
    outlived = cut_lineage(
        asof_lookup(
            ranks.select(*key, "duration_seconds", "upto"), probes, key, "duration_seconds", "upto"
        ).withColumn("outlived", F.coalesce("upto", F.lit(0)).cast("long"))
    )
    survivors = F.col("samples") - F.col("outlived")
    first_rank = F.when(survivors > 0, F.col("outlived")).otherwise(F.lit(0))
    population = F.when(survivors > 0, survivors).otherwise(F.col("samples"))
    low = first_rank + F.floor((population - 1) / 2)
    high = first_rank + F.ceil((population - 1) / 2)
    wanted = outlived.select(
        *key,
        "job_id",
        "outlived",
        F.explode(F.array(low.cast("long"), high.cast("long"))).alias("rows_before"),
    )
    middle = (
        asof_lookup(
            ranks.select(*key, "rows_before", "duration_seconds"),
            wanted,
            key,
            "rows_before",
            "duration_seconds",
        )
        .groupBy(*by, "job_id", "outlived")
        .agg(F.avg("duration_seconds").alias("median_duration"))
    )
    alive = F.col("outlived") < F.col("samples")
    raw = (
        F.when(F.col("samples") == 0, F.lit(3600.0))
        .when(alive, F.col("median_duration") - F.col("elapsed_seconds"))
        .otherwise(F.greatest(F.lit(3600.0), F.col("median_duration")))
    )
    return items.join(middle, [*by, "job_id"], "left").select(
        *by,
        "job_id",
        "service_class",
        "gpu_model",
        "gpu_count",
        "tenant_id",
        "elapsed_seconds",
        F.least(F.lit(float(horizon_seconds)), F.greatest(F.lit(60.0), raw)).alias(
            "estimated_remaining_seconds"
        ),
        F.when(F.col("samples") == 0, "sparse-history-one-hour-fallback")
        .when(alive, "conditional-survival-median")
        .otherwise("right-censored-class-median-fallback")
        .alias("estimator_method"),
        F.when(alive, F.col("samples") - F.col("outlived"))
        .otherwise(F.col("samples"))
        .cast("long")
        .alias("estimator_sample_count"),
    )


MAX_PIECES = 256


def forecast_pieces(points: DataFrame, templates: DataFrame) -> DataFrame:
    """Split each aggregate HP forecast into job-shaped pieces whose sizes add up to it.

    ``points``: point_index, gpu_model, target_time_seconds, requested_gpus, capacity_gpus.
    ``templates``: gpu_model, position (0-based), template_count, gpu_count, tenant_id. Templates
    are cycled from the point's index; a piece is never below a 256th of the request, so at most
    256 templates of a pool are looked up per point.
    """
    asked = F.least(F.col("capacity_gpus"), F.greatest(F.lit(0.0), F.col("requested_gpus")))
    live = points.withColumn("requested_gpus", asked).where(F.col("requested_gpus") > EPSILON)
    counts = templates.groupBy("gpu_model").agg(F.max("template_count").alias("template_count"))
    slots = (
        live.join(counts, "gpu_model", "left")
        .withColumn("piece_index", F.explode(F.sequence(F.lit(0), F.lit(MAX_PIECES - 1))))
        .withColumn(
            "position",
            F.when(
                F.col("template_count") > 0,
                (F.col("point_index") + F.col("piece_index")) % F.col("template_count"),
            ),
        )
    )
    shaped = slots.join(
        templates.drop("template_count").withColumnRenamed("gpu_count", "template_gpus"),
        ["gpu_model", "position"],
        "left",
    )
    fallback = F.least(
        F.col("requested_gpus"), F.greatest(F.lit(1.0), F.col("capacity_gpus") / 64.0)
    )
    size = F.greatest(
        F.col("requested_gpus") / MAX_PIECES, F.coalesce("template_gpus", fallback)
    )
    order = Window.partitionBy("gpu_model", "point_index").orderBy("piece_index")
    before = F.coalesce(
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    left = F.col("requested_gpus") - F.col("before")
    return (
        shaped.withColumn("size", size)
        .withColumn("before", before)
        .where(left > EPSILON)
        .select(
            "gpu_model",
            "point_index",
            "target_time_seconds",
            "piece_index",
            F.least(F.col("size"), left).alias("gpu_count"),
            F.coalesce("tenant_id", F.lit("forecast-aggregate")).alias("tenant_id"),
        )
    )
