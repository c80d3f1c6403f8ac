"""Hierarchical selection among audited policies, and studies over many windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import POLICIES
from ..functions import rounded
from .audit import ALLOCATION_TIE_BAND

ALLOCATION = "allocation_rate_mean"
SPOT_JCT = "spot_jct_p95_seconds"
EVICTION = "spot_eviction_rate_per_run"
# Registered controls counted when measuring how far two actions differ.
CONTROL_FIELDS = (
    "scheduler",
    "spot_guarantee_seconds",
    "checkpoint_interval_seconds",
    "hp_preemption_delay_seconds",
    "spot_eviction_budget_rate",
    "preemption_victim_strategy",
    "predictive_admission_mode",
)


def _keep_best(df: DataFrame, peers, flag: str, value: Column, best: Column, test) -> DataFrame:
    return (
        df.withColumn("_best", best.over(peers))
        .withColumn(flag, F.coalesce(F.col(flag) & test(F.col("_best"), value), F.lit(False)))
        .drop("_best")
    )


def mark_frontier(
    df: DataFrame,
    window: Sequence[str],
    eligible: Column,
    *,
    band: float = ALLOCATION_TIE_BAND,
    stress: str | None = None,
    nulls_tolerated: bool = False,
) -> DataFrame:
    """Add ``on_frontier``: near-best allocation, then least Spot p95 JCT, then least eviction.

    The allocation band is strict and relative to the best eligible value. With nulls tolerated, a
    level nobody has a value for is skipped. All levels share one partitioning by window.
    """
    peers = Window.partitionBy(*window)
    flag = "on_frontier"
    out = df.withColumn(flag, F.coalesce(eligible, F.lit(False)))
    kept = lambda c: F.when(F.col(flag), F.col(c))

    def equal_best(best: Column, value: Column) -> Column:
        return (best.isNull() | (value == best)) if nulls_tolerated else value == best

    out = _keep_best(
        out, peers, flag, F.col(ALLOCATION), F.max(kept(ALLOCATION)), lambda b, v: b - v < band
    )
    for column in (SPOT_JCT, EVICTION):
        if nulls_tolerated:
            alone = F.count_if(F.col(flag)).over(peers)
            out = out.withColumn("_alone", alone == 1)
            out = _keep_best(
                out,
                peers,
                flag,
                F.col(column),
                F.min(kept(column)),
                lambda b, v: F.col("_alone") | F.coalesce(equal_best(b, v), F.lit(False)),
            ).drop("_alone")
        else:
            out = _keep_best(out, peers, flag, F.col(column), F.min(kept(column)), equal_best)
    if stress:
        complete = F.count_if(F.col(flag) & F.col(stress).isNull()).over(peers) == 0
        out = out.withColumn("_complete", complete)
        out = _keep_best(
            out,
            peers,
            flag,
            F.col(stress),
            F.max(kept(stress)),
            lambda b, v: ~F.col("_complete") | F.coalesce(v == b, F.lit(False)),
        ).drop("_complete")
    return out


def selection(
    marked: DataFrame, window: Sequence[str], action: str = "action_id"
) -> DataFrame:
    """Status and the surviving actions of every window."""
    members = F.array_sort(F.collect_list(F.when(F.col("on_frontier"), F.col(action))))
    return marked.groupBy(*window).agg(members.alias("selected_action_ids")).withColumn(
        "selection_status",
        F.when(F.size("selected_action_ids") == 0, "no_eligible_policy")
        .when(F.size("selected_action_ids") == 1, "selected")
        .otherwise("tie_requires_human_approval"),
    )


def join_audits(metrics: DataFrame, audits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every audit with its report; an audit without one is an error. ``hard_slo_passed`` is its verdict."""
    known = metrics.withColumn("_known", F.lit(True))
    verdicts = audits.select(*keys, F.col("audit_passed").alias("hard_slo_passed"))
    checked = F.when(F.col("_known"), F.col("hard_slo_passed")).otherwise(
        F.raise_error(F.lit("an audit has no matching metrics report")).cast("boolean")
    )
    return verdicts.join(known.drop("hard_slo_passed"), list(keys), "left").withColumn("hard_slo_passed", checked).drop("_known")


def rank_policies(
    metrics: DataFrame, window: Sequence[str], *, band: float = ALLOCATION_TIE_BAND
) -> DataFrame:
    """Audited ranking of each window's three to five candidates.

    A missing ranking metric is an error for any candidate, passed or not, and so is a window with fewer or more
    candidates; a candidate whose evidence is not valid is not eligible.
    """
    missing = F.col(ALLOCATION).isNull() | F.col(SPOT_JCT).isNull() | F.col(EVICTION).isNull()
    peers = Window.partitionBy(*window)
    valid = F.coalesce("evidence_valid", F.lit(False)) if "evidence_valid" in metrics.columns else F.lit(True)
    error = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    judged = metrics.withColumn("_size", F.count(F.lit(1)).over(peers)).withColumn(
        "_eligible",
        F.when(missing, error("ranking metric is unavailable"))
        .when(~F.col("_size").between(3, 5), error("ranking needs between 3 and 5 candidates"))
        .otherwise(F.coalesce("hard_slo_passed", F.lit(False)) & valid),
    )
    return selection(mark_frontier(judged, window, F.col("_eligible"), band=band), window)


def control_distance(action: Column, other: Column) -> Column:
    """How many registered controls two catalog actions differ in."""

    def profile(name: Column) -> Column:
        entries = []
        for policy in POLICIES.values():
            controls = F.struct(
                *[F.lit(str(getattr(policy, f))).alias(f) for f in CONTROL_FIELDS]
            )
            entries += [F.lit(policy.action_id), controls]
        return F.element_at(F.create_map(*entries), name)

    mine, theirs = profile(action), profile(other)
    total = F.lit(0)
    for field in CONTROL_FIELDS:
        total = total + (mine[field] != theirs[field]).cast("int")
    return total


def rolling_selection(
    candidates: DataFrame,
    window: Sequence[str],
    *,
    active: str = "active_action_id",
    baseline_action: str = "native-fifo",
    band: float = ALLOCATION_TIE_BAND,
) -> DataFrame:
    """Rolling choice: the tolerant hierarchy, then declared fallbacks for ties and empty sets."""
    marked = mark_frontier(
        candidates,
        window,
        F.col("hard_slo_passed") & F.col(ALLOCATION).isNotNull(),
        band=band,
        stress="stress_scenario_pass_count",
        nulls_tolerated=True,
    ).withColumn("_distance", control_distance(F.col("action_id"), F.col(active)))
    peers = Window.partitionBy(*window)
    present = F.bool_or(F.col("action_id") == F.col(active)).over(peers)
    nearest = F.min(F.when(F.col("on_frontier"), F.col("_distance"))).over(peers)
    marked = marked.withColumn("_present", present).withColumn("_nearest", nearest)
    on = F.col("on_frontier")
    closest = on & (F.col("_distance") == F.col("_nearest"))
    facts = marked.groupBy(*window).agg(
        F.first(active).alias("_active"),
        F.array_sort(F.collect_list(F.when(on, F.col("action_id")))).alias("frontier"),
        F.array_sort(
            F.collect_list(F.when(closest & F.col("_present"), F.col("action_id")))
        ).alias("_closest"),
    )
    size = F.size("frontier")
    tied_active = F.array_contains("frontier", F.col("_active"))
    tied_base = F.array_contains("frontier", F.lit(baseline_action))
    unique_nearest = F.size("_closest") == 1
    return facts.select(
        *window,
        F.col("frontier").alias("frontier_action_ids"),
        F.when(size == 0, F.lit(baseline_action))
        .when(size == 1, F.col("frontier")[0])
        .when(tied_active, F.col("_active"))
        .when(unique_nearest, F.col("_closest")[0])
        .when(tied_base, F.lit(baseline_action))
        .otherwise(F.col("frontier")[0])
        .alias("selected_action_id"),
        F.when(size == 0, "no_eligible_policy_safe_fifo")
        .when(size == 1, "selected")
        .when(~tied_active & unique_nearest, "tie_resolved_by_minimum_control_change")
        .otherwise("tie_with_declared_safety_fallback")
        .alias("selection_status"),
    )


def with_baseline(
    metrics: DataFrame,
    window: Sequence[str],
    columns: Sequence[str],
    action: str = "action_id",
    baseline_action: str = "native-fifo",
) -> DataFrame:
    """Attach the same-window baseline's columns as ``baseline_<name>``."""
    peers = Window.partitionBy(*window)
    out = metrics
    for column in columns:
        out = out.withColumn(
            f"baseline_{column}",
            F.max(F.when(F.col(action) == baseline_action, F.col(column))).over(peers),
        )
    return out


def spread(value: Column | str, name: str) -> list[Column]:
    """mean / median / min / max at nine digits; rows are windows, so a group is small."""
    return [
        rounded(F.avg(value), 9).alias(f"{name}_mean"),
        rounded(F.percentile(value, F.lit(0.5)), 9).alias(f"{name}_median"),
        rounded(F.min(value), 9).alias(f"{name}_min"),
        rounded(F.max(value), 9).alias(f"{name}_max"),
    ]


def signs(value: Column, name: str, epsilon: float = 0.0) -> list[Column]:
    return [
        F.count_if(value > epsilon).alias(f"{name}_positive"),
        F.count_if(F.abs(value) <= epsilon).alias(f"{name}_equal"),
        F.count_if(value < -epsilon).alias(f"{name}_negative"),
    ]


def policy_robustness(metrics: DataFrame, window: str = "window_id") -> DataFrame:
    """Per-action behaviour across windows against the same-window FIFO run."""
    based = with_baseline(metrics, [window], [ALLOCATION, "hp_jct_p95_seconds"])
    delta = F.col(ALLOCATION) - F.col(f"baseline_{ALLOCATION}")
    regression = (F.col("hp_jct_p95_seconds") - F.col("baseline_hp_jct_p95_seconds")) / F.col(
        "baseline_hp_jct_p95_seconds"
    )
    based = based.withColumn("_delta", delta).withColumn("_regression", regression)
    n = F.count(F.lit(1))
    return based.groupBy("action_id").agg(
        n.alias("window_count"),
        F.count_if("deterministic_repetitions").alias("deterministic_window_count"),
        F.count_if("hard_slo_passed").alias("hard_slo_pass_count"),
        rounded(F.count_if("hard_slo_passed") / n, 9).alias("hard_slo_pass_rate"),
        *spread(ALLOCATION, "allocation"),
        *spread("_delta", "allocation_delta"),
        *signs(F.col("_delta"), "allocation_delta"),
        *spread("_regression", "hp_jct_regression"),
        *spread(EVICTION, "eviction"),
    )


def best_hard_pass_uplift(metrics: DataFrame, window: str = "window_id") -> DataFrame:
    """Across windows: the best passing allocation minus FIFO's, and windows where all pass."""
    per_window = metrics.groupBy(window).agg(
        (
            F.max(F.when(F.col("hard_slo_passed"), F.col(ALLOCATION)))
            - F.max(F.when(F.col("action_id") == "native-fifo", F.col(ALLOCATION)))
        ).alias("_uplift"),
        F.bool_and("hard_slo_passed").alias("_all"),
    )
    return per_window.agg(
        F.count(F.lit(1)).alias("window_count"),
        F.count_if("_all").alias("all_hard_slo_pass_window_count"),
        *spread("_uplift", "uplift"),
        *signs(F.col("_uplift"), "uplift"),
    )


def frontier_frequency(selected: DataFrame) -> DataFrame:
    """How often each status and each frontier action occurs."""
    status = selected.groupBy(F.col("selection_status").alias("name")).agg(
        F.count(F.lit(1)).alias("window_count")
    )
    actions = (
        selected.select(F.explode("selected_action_ids").alias("name"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("window_count"))
    )
    return status.select(F.lit("status").alias("kind"), "*").unionByName(
        actions.select(F.lit("action").alias("kind"), "*")
    )


def static_choice(metrics: DataFrame) -> DataFrame:
    """One action for all calibration windows: passes, then allocation, JCT, eviction means."""
    passing = lambda c: F.avg(F.when(F.col("hard_slo_passed"), F.col(c)))
    stats = metrics.groupBy("action_id").agg(
        F.count_if("hard_slo_passed").alias("pass_count"),
        rounded(passing(ALLOCATION), 9).alias("mean_allocation"),
        rounded(passing(SPOT_JCT), 9).alias("mean_spot_jct"),
        rounded(passing(EVICTION), 9).alias("mean_eviction"),
    )
    level = (
        F.col("pass_count").cast("double"),
        F.coalesce("mean_allocation", F.lit(0.0)),
        # A zero mean is treated like a missing one here, as it is in the declared hierarchy.
        -F.coalesce(F.nullif("mean_spot_jct", F.lit(0.0)), F.lit(float("inf"))),
        -F.coalesce("mean_eviction", F.lit(0.0)),
    )
    score = F.struct(*[c.alias(f"l{i}") for i, c in enumerate(level)])
    best = F.max(score).over(Window.partitionBy())
    return stats.withColumn("selected", score == best)


def calibration_selection(
    metrics: DataFrame, window: str = "window_id", *, band: float = ALLOCATION_TIE_BAND
) -> DataFrame:
    """Arms that pass and repeat exactly in every window, through the mean-based hierarchy."""
    n = F.count(F.lit(1))
    means = metrics.groupBy("action_id").agg(
        n.alias("window_count"),
        F.count_if("hard_slo_passed").alias("hard_slo_pass_count"),
        F.count_if("deterministic_repetitions").alias("deterministic_window_count"),
        *[rounded(F.avg(c), 9).alias(c) for c in (ALLOCATION, SPOT_JCT, EVICTION)],
    )
    return mark_frontier(
        means,
        [],
        (F.col("hard_slo_pass_count") == F.col("window_count"))
        & (F.col("deterministic_window_count") == F.col("window_count")),
        band=band,
    )


def partition_summary(records: DataFrame, failures: DataFrame, window: str = "window_id") -> DataFrame:
    """Per (partition, arm) statistics with the hard constraints that failed and how often."""
    based = with_baseline(records, [window], [ALLOCATION]).withColumn(
        "_delta", F.col(ALLOCATION) - F.col(f"baseline_{ALLOCATION}")
    )
    n = F.count(F.lit(1))
    key = ["partition", "action_id"]
    stats = based.groupBy(*key).agg(
        n.alias("window_count"),
        F.count_if("deterministic_repetitions").alias("deterministic_window_count"),
        F.count_if("hard_slo_passed").alias("hard_slo_pass_count"),
        rounded(F.count_if("hard_slo_passed") / n, 9).alias("hard_slo_pass_rate"),
        *spread(ALLOCATION, "allocation"),
        *spread("_delta", "allocation_delta"),
        *signs(F.col("_delta"), "allocation_delta"),
        *spread("hp_jct_p95_seconds", "hp_jct"),
        *spread(SPOT_JCT, "spot_jct"),
        *spread(EVICTION, "eviction"),
        *spread("spot_guarantee_success_rate", "guarantee"),
    )
    counted = (
        failures.select(*key, F.explode("failed_hard_constraints").alias("constraint_id"))
        .groupBy(*key, "constraint_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*key)
        .agg(
            F.array_join(
                F.array_sort(
                    F.collect_list(F.concat_ws(":", "constraint_id", F.col("n").cast("string")))
                ),
                ",",
            ).alias("failed_constraint_windows")
        )
    )
    return stats.join(counted, key, "left").withColumn(
        "failed_constraint_windows", F.coalesce("failed_constraint_windows", F.lit(""))
    )


def rule_controller(split: DataFrame) -> DataFrame:
    """Three bounded candidates per evaluation window from calibration medians alone."""
    pressure, share = F.col("combined_peak_active_pressure"), F.col("spot_requested_gpu_share")
    calibrating = F.col("partition") == "calibration"
    middle = lambda c: F.percentile(F.when(calibrating, c), F.lit(0.5)).over(Window.partitionBy())
    split = split.withColumns({"pressure_median": middle(pressure), "share_median": middle(share)})
    crowded, spotty = pressure >= F.col("pressure_median"), share >= F.col("share_median")
    delayed, direct, aware = (
        "native-preemptive-g3600-b09-d0900",
        "native-preemptive-g3600-b09-d0000",
        "native-preemptive-g3600-b09-loss-aware",
    )
    # Candidate pairs that join FIFO in each pressure / Spot-share quadrant.
    quadrant = {
        "high-pressure-high-spot-share": (crowded & spotty, (direct, aware)),
        "high-pressure-lower-spot-share": (crowded & ~spotty, ("native-preemptive-3600", direct)),
        "lower-pressure-high-spot-share": (~crowded & spotty, (delayed, aware)),
        "lower-pressure-lower-spot-share": (~crowded & ~spotty, (direct, delayed)),
    }
    reason = F.coalesce(*[F.when(c, F.lit(name)) for name, (c, _) in quadrant.items()])
    chosen = F.coalesce(
        *[
            F.when(c, F.array(F.lit("native-fifo"), *[F.lit(a) for a in pair]))
            for c, pair in quadrant.values()
        ]
    )
    return split.where(F.col("partition") == "evaluation").select(
        F.col("date").alias("window_id"),
        reason.alias("reason_code"),
        chosen.alias("candidate_action_ids"),
    )


def controller_windows(metrics: DataFrame, controller: DataFrame) -> DataFrame:
    """Per evaluation window: the controller's frontier against the whole catalog's."""
    window = ["window_id"]
    joined = metrics.join(controller, "window_id").withColumn(
        "is_candidate", F.array_contains("candidate_action_ids", F.col("action_id"))
    )
    mine = mark_frontier(joined, window, F.col("hard_slo_passed") & F.col("is_candidate"))
    both = mark_frontier(
        mine.withColumnRenamed("on_frontier", "mine"), window, F.col("hard_slo_passed")
    ).withColumnRenamed("on_frontier", "oracle")
    when = lambda c, v: F.when(c, F.col(v))
    fifo = F.col("action_id") == "native-fifo"
    passing = F.col("hard_slo_passed")
    out = both.groupBy(*window, "reason_code").agg(
        F.size(F.first("candidate_action_ids")).alias("candidate_count"),
        F.count(F.lit(1)).alias("catalog_count"),
        F.array_sort(F.collect_list(when(F.col("mine"), "action_id"))).alias("frontier"),
        F.array_sort(F.collect_list(when(F.col("oracle"), "action_id"))).alias("oracle_frontier"),
        F.max(when(passing & F.col("is_candidate"), ALLOCATION)).alias("best_candidate"),
        F.max(when(passing, ALLOCATION)).alias("best_oracle"),
        F.max(when(fifo, ALLOCATION)).alias("fifo_allocation"),
        F.max(when(fifo, SPOT_JCT)).alias("fifo_jct"),
        F.max(when(fifo, EVICTION)).alias("fifo_eviction"),
        F.min(when(F.col("mine"), ALLOCATION)).alias("selected_min"),
        F.max(when(F.col("mine"), ALLOCATION)).alias("selected_max"),
        F.min(when(F.col("mine"), SPOT_JCT)).alias("selected_jct"),
        F.min(when(F.col("mine"), EVICTION)).alias("selected_eviction"),
    )
    return out.select(
        "*",
        (F.size(F.array_intersect("frontier", "oracle_frontier")) > 0).alias("covered"),
        ((F.size("oracle_frontier") > 0) & (F.col("frontier") == F.col("oracle_frontier"))).alias(
            "exact_match"
        ),
        F.greatest(F.lit(0.0), F.col("best_oracle") - F.col("best_candidate")).alias("_gap"),
    ).withColumn(
        "regret",
        F.when(F.col("best_oracle").isNotNull() & F.col("best_candidate").isNotNull(), F.col("_gap")),
    ).drop("_gap")


def controller_summary(windows: DataFrame) -> DataFrame:
    feasible = F.count_if(F.col("best_oracle").isNotNull())
    rate = lambda c: F.when(feasible > 0, rounded(F.count_if(c) / feasible, 9))
    uplift = F.col("best_candidate") - F.col("fifo_allocation")
    lower = F.col("selected_min") - F.col("fifo_allocation")
    upper = F.col("selected_max") - F.col("fifo_allocation")
    jct = F.col("selected_jct") - F.col("fifo_jct")
    eviction = F.col("selected_eviction") - F.col("fifo_eviction")
    p95 = lambda c: rounded(F.percentile(c, F.lit(0.95)), 9)
    best_covered = F.coalesce(F.col("regret") <= 1e-12, F.lit(False))
    return windows.agg(
        F.count(F.lit(1)).alias("evaluation_window_count"),
        F.count_if(F.size("frontier") > 0).alias("hard_slo_feasible_window_count"),
        feasible.alias("oracle_feasible_window_count"),
        F.count_if("covered").alias("coverage_window_count"),
        rate(F.col("covered")).alias("coverage_rate"),
        F.count_if("exact_match").alias("exact_match_window_count"),
        rate(F.col("exact_match")).alias("exact_match_rate"),
        F.sum("candidate_count").cast("long").alias("candidate_evaluation_count"),
        rounded(F.avg("candidate_count"), 9).alias("candidate_count_mean"),
        rounded(1 - F.sum("candidate_count") / F.sum("catalog_count"), 9).alias(
            "evaluation_reduction"
        ),
        F.count_if(F.size("frontier") == 1).alias("selected_windows"),
        F.count_if(F.size("frontier") > 1).alias("tied_windows"),
        F.count_if(F.size("frontier") == 0).alias("empty_windows"),
        rounded(F.avg(lower), 9).alias("uplift_mean_lower"),
        rounded(F.avg(upper), 9).alias("uplift_mean_upper"),
        rounded(F.max(upper), 9).alias("uplift_max_upper"),
        *signs(lower, "uplift_lower", 1e-12),
        rounded(F.avg(jct), 9).alias("jct_delta_mean"),
        p95(jct).alias("jct_delta_p95"),
        rounded(F.min(jct), 9).alias("jct_delta_min"),
        rounded(F.max(jct), 9).alias("jct_delta_max"),
        rounded(F.avg(eviction), 9).alias("eviction_delta_mean"),
        p95(eviction).alias("eviction_delta_p95"),
        F.count_if(best_covered).alias("best_allocation_covered_windows"),
        rate(best_covered).alias("best_allocation_covered_rate"),
        rounded(F.avg("regret"), 9).alias("regret_mean"),
        p95(F.col("regret")).alias("regret_p95"),
        rounded(F.max("regret"), 9).alias("regret_max"),
        rounded(F.avg(uplift), 9).alias("candidate_uplift_mean"),
        p95(uplift).alias("candidate_uplift_p95"),
        rounded(F.max(uplift), 9).alias("candidate_uplift_max"),
        *signs(uplift, "candidate_uplift", 1e-12),
    )


def arm_aggregate(records: DataFrame) -> DataFrame:
    """Rolling study arms: passes, means over present values, simulation and call budgets."""
    return records.groupBy("arm_id").agg(
        F.count(F.lit(1)).alias("window_count"),
        F.count_if("hard_slo_passed").alias("hard_slo_pass_count"),
        *[rounded(F.avg(c), 9).alias(c) for c in (ALLOCATION, SPOT_JCT, EVICTION)],
        F.coalesce(F.sum("candidate_simulation_count"), F.lit(0)).alias(
            "candidate_simulation_count"
        ),
        F.coalesce(F.sum("llm_call_count"), F.lit(0)).alias("llm_call_count"),
    )


def arm_verdict(left: str, right: str, *, passes_first: bool = True) -> Column:
    """better / worse / tie of two aliased arm rows. Not transitive, so never a sort key."""
    gap = lambda c: F.col(f"{left}.{c}") - F.col(f"{right}.{c}")
    passes, allocation = gap("hard_slo_pass_count"), gap(ALLOCATION)
    jct, eviction = gap(SPOT_JCT), gap(EVICTION)
    verdict = F.when(passes > 0, "better").when(passes < 0, "worse") if passes_first else F
    return (
        verdict.when((F.abs(allocation) >= ALLOCATION_TIE_BAND) & (allocation > 0), "better")
        .when(F.abs(allocation) >= ALLOCATION_TIE_BAND, "worse")
        .when(jct < 0, "better")
        .when(jct > 0, "worse")
        .when(eviction < 0, "better")
        .when(eviction > 0, "worse")
        .otherwise("tie")
    )


def arm_comparisons(arms: DataFrame, subject: str = "rolling-multi-agent") -> DataFrame:
    """The subject against every other arm; arms are a declared enumeration, one row each."""
    row = F.struct(*arms.columns)
    mine = F.max(F.when(F.col("arm_id") == subject, row)).over(Window.partitionBy())
    paired = arms.select(row.alias("r"), mine.alias("l")).where((F.col("r.arm_id") != subject) & F.col("l").isNotNull())
    return paired.select(
        F.col("r.arm_id").alias("comparator_arm_id"),
        arm_verdict("l", "r").alias("verdict"),
        (F.col("l.hard_slo_pass_count") >= F.col("r.hard_slo_pass_count")).alias("no_fewer_passes"),
        (F.col("l.candidate_simulation_count") == F.col("r.candidate_simulation_count")).alias(
            "equal_simulation_budget"
        ),
        (F.col("l.llm_call_count") == F.col("r.llm_call_count")).alias("equal_call_budget"),
        (F.col("l.window_count") == F.col("r.window_count")).alias("equal_windows"),
    )


def claim_gates(comparisons: DataFrame) -> DataFrame:
    """Which claims the comparisons support; a gate without its comparators is incomplete."""
    arm = F.col("comparator_arm_id")
    masked = arm == "rolling-multi-agent-masked"
    required = [
        "ordinary-fifo",
        "fixed-tenant-predictive",
        "rolling-workload-rule",
        "rolling-single-agent",
    ]
    needed = arm.isin(*required) | masked
    budgeted = arm.isin("rolling-workload-rule", "rolling-single-agent") | masked
    better = F.col("verdict") == "better"
    complete = F.count_if(arm.isin(*required)) == len(required)
    superiority = F.bool_and(~needed | F.col("no_fewer_passes")) & F.bool_and(
        ~budgeted | (F.col("equal_simulation_budget") & better)
    )
    causal = F.bool_or(
        masked
        & better
        & F.col("equal_windows")
        & F.col("equal_simulation_budget")
        & F.col("equal_call_budget")
    )

    def gate(ready: Column, holds: Column) -> Column:
        return (
            F.when(~F.coalesce(ready, F.lit(False)), "incomplete")
            .when(F.coalesce(holds, F.lit(False)), "supported")
            .otherwise("not_established")
        )

    return comparisons.agg(
        gate(complete, superiority).alias("superiority_gate"),
        gate(
            F.bool_or(arm == "ordinary-fifo"), F.bool_or((arm == "ordinary-fifo") & better)
        ).alias("ordinary_gate"),
        gate(F.bool_or(masked), causal).alias("causal_gate"),
    )


def closeout(arms: DataFrame) -> DataFrame:
    """Arms that pass in every window, ranked by duels of each with all others, and the one recommended.

    Arms stand by wins less losses, then by arm_id; the first is recommended unless it ties with the second. Where
    the pairwise rule is transitive this is its sorted order, and where it runs in a circle the order is still defined.
    The arms are a declared enumeration, so each holds the others in one array.
    """
    eligible = arms.where(
        (F.col("arm_id") != "posthoc-catalog-oracle")
        & (F.col("hard_slo_pass_count") == F.col("window_count"))
    )
    everyone = Window.partitionBy()
    fields = [c for c in arms.columns]
    rivals = eligible.withColumn("_all", F.collect_list(F.struct(*fields)).over(everyone)).select(
        F.struct(*fields).alias("l"), F.explode("_all").alias("r")
    )
    verdict = F.when(F.col("l.arm_id") != F.col("r.arm_id"), arm_verdict("l", "r", passes_first=False))
    duel = F.struct(F.col("rival"), F.col("v"))
    counted = rivals.select(F.col("l.arm_id").alias("arm_id"), F.col("r.arm_id").alias("rival"), verdict.alias("v")).groupBy("arm_id").agg(
        F.count_if(F.col("v") == "better").alias("wins"),
        F.count_if(F.col("v") == "worse").alias("losses"),
        F.count_if(F.col("v") == "tie").alias("ties"),
        F.map_from_entries(F.collect_list(duel)).alias("_duels"),
    )
    order = everyone.orderBy(F.desc(F.col("wins") - F.col("losses")), "arm_id")
    ranked = counted.withColumns({"position": F.row_number().over(order).cast("long"), "_second": F.lead("arm_id").over(order)})
    against_second = F.col("_duels")[F.col("_second")]
    recommended = (F.col("position") == 1) & F.coalesce(against_second != "tie", F.lit(True))
    return ranked.withColumn("recommended", recommended).drop("_duels", "_second")


def study_violations(
    windows: DataFrame, *, window_seconds: int, minimum_history_seconds: float
) -> DataFrame:
    """Rules a frozen study must keep, each with the number of windows breaking it."""
    order = Window.orderBy("position")
    checked = windows.withColumn("_prev", F.lag("start_seconds").over(order)).withColumn(
        "_prev_partition", F.lag("partition").over(order)
    )
    repeats = Window.partitionBy("date")
    checked = checked.withColumn("_same_date", F.count(F.lit(1)).over(repeats))
    rules = {
        "not_chronological": F.col("start_seconds") <= F.col("_prev"),
        "wrong_size": F.col("end_seconds") - F.col("start_seconds") + 1 != window_seconds,
        "too_little_history": F.col("start_seconds") < minimum_history_seconds,
        "repeated_date": F.col("_same_date") > 1,
        "calibration_after_evaluation": (F.col("partition") == "calibration")
        & (F.col("_prev_partition") == "evaluation"),
        "unknown_partition": ~F.col("partition").isin("calibration", "evaluation"),
    }
    wide = checked.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return wide.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violation_count")) for n in rules])
        )
    )


def study_receipt(
    metrics: DataFrame, audits: DataFrame, selected: DataFrame, snapshot: Sequence[str]
) -> DataFrame:
    """A study's public rows, without any job: per window and arm its verdict and metrics, and the study's status.

    ``metrics`` has window_id, partition and action_id; ``selected`` the arms chosen on the calibration windows.
    An arm stands if it passes every holdout window.
    """
    chosen = selected.select("action_id").distinct()
    holdout = metrics.where(F.col("partition") == "holdout").groupBy("action_id").agg(F.bool_and("hard_slo_passed").alias("stands"))
    tally = chosen.join(holdout, "action_id", "left").agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce("stands", F.lit(False))).alias("all_stand")
    )
    status = (
        F.when(F.col("n") == 0, "no_calibration_eligible_arm")
        .when(~F.col("all_stand"), "holdout_rejected")
        .when(F.col("n") == 1, "holdout_passed")
        .otherwise("holdout_tie_requires_human_approval")
    )
    verdicts = audits.select("window_id", "action_id", "failed_hard_constraints")
    rows = metrics.select("window_id", "partition", "action_id", "hard_slo_passed", "deterministic_repetitions", *snapshot)
    return rows.join(verdicts, ["window_id", "action_id"]).withColumn("study_status", tally.select(status).scalar())
