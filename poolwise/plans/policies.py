"""Registered queries over policy metrics: audit, ranking, comparison, studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..contracts import DAY, MULTIWINDOW_ACTIONS, POLICIES
from ..functions import rounded
from ..operators import audit, compare, ranking
from ..sources.ledger import ARM_RECORDS_CTES, REPORT_CTES, arm_records, policy_metrics
from ..sources.tables import TRACE_CTES
from .registry import query
from .workload import SPLIT, split_windows

def _constraint_values() -> str:
    rows = []
    for c in audit.DEMO_SLO:
        absolute = "NULL" if c.threshold is None else f"{c.threshold}"
        base = "NULL" if c.baseline_metric is None else f"'{c.baseline_metric}'"
        rows.append(
            f"('{c.id}', '{c.metric}', '{c.operator}', '{c.severity}', {absolute}::DOUBLE, {base}, {c.multiplier}::DOUBLE)"
        )
    return "(VALUES " + ", ".join(rows) + ") c(constraint_id, metric, op, severity, absolute, base_metric, mult)"


METRIC_NAMES = ", ".join(audit.METRIC_CATALOG)


def _long_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT window_id, action_id, metric, value FROM (SELECT window_id, action_id, {METRIC_NAMES} FROM {source})
  UNPIVOT INCLUDE NULLS (value FOR metric IN ({METRIC_NAMES})))"""


def _audit_sql(source: str, name: str) -> str:
    """The audit of a report table, as CTE ``name``."""
    shared = " AND ".join(f"b.{c} IS NOT DISTINCT FROM p.{c}" for c in audit.SHARED)
    usable = f"coalesce(b.scheduler = 'fifo' AND b.evidence_valid AND {shared}, false)"
    return f"""{_long_sql(source, name + "_long")},
{name}0 AS (SELECT p.window_id, p.action_id, p.hp_job_count, p.spot_job_count, {", ".join("p." + c for c in audit.EVIDENCE)}, {usable} AS baseline_compatible,
    c.constraint_id, c.metric, c.severity, c.op, o.value AS observed,
    CASE WHEN c.base_metric IS NULL THEN c.absolute WHEN {usable} THEN t.value * c.mult + 0.0 END AS threshold
  FROM {source} p LEFT JOIN {source} b ON b.window_id = p.window_id AND b.action_id = 'native-fifo' CROSS JOIN {_constraint_values()}
  LEFT JOIN {name}_long o ON o.window_id = p.window_id AND o.action_id = p.action_id AND o.metric = c.metric
  LEFT JOIN {name}_long t ON t.window_id = p.window_id AND t.action_id = 'native-fifo' AND t.metric = c.base_metric),
{name}1 AS (SELECT *, coalesce(CASE op WHEN '<=' THEN observed <= threshold WHEN '>=' THEN observed >= threshold END, false) AS passed FROM {name}0),
{name} AS (SELECT *, CASE WHEN passed THEN 'passed' WHEN observed IS NULL OR threshold IS NULL THEN 'unavailable' ELSE 'failed' END AS status FROM {name}1)"""


VERDICT = "bool_and(passed OR severity <> 'hard') AND bool_and(baseline_compatible)" + "".join(f" AND bool_and({c})" for c in audit.EVIDENCE)
PM = f"""WITH {REPORT_CTES},
{_audit_sql("pm0", "judged")},
verdicts AS (SELECT window_id, action_id, {VERDICT} AS hard_slo_passed FROM judged GROUP BY 1, 2),
pm AS (SELECT pm0.*, hard_slo_passed, CAST(coalesce(spot_eviction_rate_per_run <= 0.08, false) AS BIGINT)
    + CAST(coalesce(hp_queue_p95_seconds <= 3500, false) AS BIGINT) AS stress_scenario_pass_count FROM pm0 JOIN verdicts USING (window_id, action_id))
"""
LONG = _long_sql("pm", "long")
AUDIT = _audit_sql("pm", "aud")
RELAXED = f"""rel AS (SELECT *, status = 'unavailable' AND ((metric LIKE 'hp\\_%' ESCAPE '\\' AND hp_job_count = 0)
    OR (metric LIKE 'spot\\_%' ESCAPE '\\' AND spot_job_count = 0)) AS vacuous,
    severity = 'hard' AND constraint_id NOT IN {audit.PROSPECTIVE_CONSTRAINTS} AS waits FROM aud)"""
CANDIDATE_PASS = "cp AS (SELECT window_id, action_id, bool_and(passed OR vacuous OR waits OR severity <> 'hard') AS ok FROM rel GROUP BY 1, 2)"
AR = PM + "," + ARM_RECORDS_CTES
WINDOW = ["window_id"]

FRONTIER = """
f1 AS (SELECT *, max(CASE WHEN hard_slo_passed THEN allocation_rate_mean END) OVER w AS ba FROM pm WINDOW w AS (PARTITION BY window_id)),
f2 AS (SELECT *, hard_slo_passed AND ba - allocation_rate_mean < 0.01 AS k1 FROM f1),
f3 AS (SELECT *, k1 AND spot_jct_p95_seconds = min(CASE WHEN k1 THEN spot_jct_p95_seconds END) OVER (PARTITION BY window_id) AS k2 FROM f2),
f4 AS (SELECT *, coalesce(k2 AND spot_eviction_rate_per_run = min(CASE WHEN k2 THEN spot_eviction_rate_per_run END)
    OVER (PARTITION BY window_id), false) AS on_frontier FROM f3),
sel AS (SELECT window_id, coalesce(string_agg(action_id, ',' ORDER BY action_id) FILTER (on_frontier), '') AS selected_action_ids,
    CASE count(*) FILTER (on_frontier) WHEN 0 THEN 'no_eligible_policy' WHEN 1 THEN 'selected'
      ELSE 'tie_requires_human_approval' END AS selection_status FROM f4 GROUP BY 1)
"""


@query("q_rank_policies", PM + "," + FRONTIER + "SELECT * FROM sel")
def rank_policies(spark, sf_dir):
    return ranking.rank_policies(policy_metrics(spark, sf_dir), WINDOW).withColumn(
        "selected_action_ids", F.array_join("selected_action_ids", ",")
    )


@query("q_frontier", PM + "," + FRONTIER + "SELECT window_id, action_id FROM f4 WHERE on_frontier")
def frontier(spark, sf_dir):
    marked = ranking.mark_frontier(
        policy_metrics(spark, sf_dir), WINDOW, F.col("hard_slo_passed")
    )
    return marked.where("on_frontier").select("window_id", "action_id")


@query(
    "q_frontier_frequency",
    PM
    + ","
    + FRONTIER
    + """SELECT 'status' AS kind, selection_status AS name, CAST(count(*) AS BIGINT) AS window_count FROM sel GROUP BY 2
UNION ALL SELECT 'action', action_id, count(*) FROM f4 WHERE on_frontier GROUP BY 2""",
)
def frontier_frequency(spark, sf_dir):
    return ranking.frontier_frequency(
        ranking.rank_policies(policy_metrics(spark, sf_dir), WINDOW)
    )


BASED = """
based AS (SELECT pm.*, b.allocation_rate_mean AS base_alloc, b.hp_jct_p95_seconds AS base_jct,
    pm.allocation_rate_mean - b.allocation_rate_mean AS delta,
    (pm.hp_jct_p95_seconds - b.hp_jct_p95_seconds) / b.hp_jct_p95_seconds AS regression
  FROM pm LEFT JOIN pm b ON b.window_id = pm.window_id AND b.action_id = 'native-fifo')
"""


@query(
    "q_delta_vs_baseline",
    PM
    + ","
    + BASED
    + """SELECT window_id, action_id, round(delta, 9) + 0.0 AS allocation_delta, round(regression, 9) + 0.0 AS hp_jct_regression FROM based""",
)
def delta_vs_baseline(spark, sf_dir):
    based = ranking.with_baseline(
        policy_metrics(spark, sf_dir), WINDOW, [ranking.ALLOCATION, "hp_jct_p95_seconds"]
    )
    base_jct = F.col("baseline_hp_jct_p95_seconds")
    return based.select(
        "window_id",
        "action_id",
        rounded(F.col(ranking.ALLOCATION) - F.col("baseline_allocation_rate_mean"), 9).alias(
            "allocation_delta"
        ),
        rounded((F.col("hp_jct_p95_seconds") - base_jct) / base_jct, 9).alias("hp_jct_regression"),
    )


def _spread_sql(value: str, name: str) -> str:
    return (
        f"round(avg({value}), 9) + 0.0 AS {name}_mean, round(quantile_cont({value}, 0.5), 9) + 0.0 AS {name}_median, "
        f"round(min({value}), 9) + 0.0 AS {name}_min, round(max({value}), 9) + 0.0 AS {name}_max"
    )


def _signs_sql(value: str, name: str, eps: str = "0") -> str:
    return (
        f"CAST(count(*) FILTER ({value} > {eps}) AS BIGINT) AS {name}_positive, "
        f"CAST(count(*) FILTER (abs({value}) <= {eps}) AS BIGINT) AS {name}_equal, "
        f"CAST(count(*) FILTER ({value} < -{eps}) AS BIGINT) AS {name}_negative"
    )


COUNTS = """CAST(count(*) AS BIGINT) AS window_count,
  CAST(count(*) FILTER (deterministic_repetitions) AS BIGINT) AS deterministic_window_count,
  CAST(count(*) FILTER (hard_slo_passed) AS BIGINT) AS hard_slo_pass_count,
  round(count(*) FILTER (hard_slo_passed) / count(*)::DOUBLE, 9) AS hard_slo_pass_rate"""


@query(
    "q_policy_robustness",
    PM
    + ","
    + BASED
    + f"""SELECT action_id, {COUNTS}, {_spread_sql('allocation_rate_mean', 'allocation')}, {_spread_sql('delta', 'allocation_delta')},
  {_signs_sql('delta', 'allocation_delta')}, {_spread_sql('regression', 'hp_jct_regression')},
  {_spread_sql('spot_eviction_rate_per_run', 'eviction')} FROM based GROUP BY 1""",
)
def policy_robustness(spark, sf_dir):
    return ranking.policy_robustness(policy_metrics(spark, sf_dir))


@query(
    "q_best_hard_pass_uplift",
    PM
    + f""", per AS (SELECT window_id, max(allocation_rate_mean) FILTER (hard_slo_passed)
    - max(allocation_rate_mean) FILTER (action_id = 'native-fifo') AS uplift, bool_and(hard_slo_passed) AS every FROM pm GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS window_count, CAST(count(*) FILTER (every) AS BIGINT) AS all_hard_slo_pass_window_count,
  {_spread_sql('uplift', 'uplift')}, {_signs_sql('uplift', 'uplift')} FROM per""",
)
def best_hard_pass_uplift(spark, sf_dir):
    return ranking.best_hard_pass_uplift(policy_metrics(spark, sf_dir))


@query(
    "q_static_choice",
    PM
    + """, s AS (SELECT action_id, CAST(count(*) FILTER (hard_slo_passed) AS BIGINT) AS pass_count,
    round(avg(allocation_rate_mean) FILTER (hard_slo_passed), 9) AS mean_allocation,
    round(avg(spot_jct_p95_seconds) FILTER (hard_slo_passed), 9) AS mean_spot_jct,
    round(avg(spot_eviction_rate_per_run) FILTER (hard_slo_passed), 9) AS mean_eviction FROM pm GROUP BY 1),
s1 AS (SELECT *, pass_count = max(pass_count) OVER () AS a FROM s),
s2 AS (SELECT *, a AND coalesce(mean_allocation, 0) = max(CASE WHEN a THEN coalesce(mean_allocation, 0) END) OVER () AS b FROM s1),
s3 AS (SELECT *, b AND coalesce(nullif(mean_spot_jct, 0), 'inf'::DOUBLE) = min(CASE WHEN b THEN coalesce(nullif(mean_spot_jct, 0), 'inf'::DOUBLE) END) OVER () AS c FROM s2)
SELECT action_id, pass_count, mean_allocation, mean_spot_jct, mean_eviction,
  c AND coalesce(mean_eviction, 0) = min(CASE WHEN c THEN coalesce(mean_eviction, 0) END) OVER () AS selected FROM s3""",
)
def static_choice(spark, sf_dir):
    return ranking.static_choice(policy_metrics(spark, sf_dir))


@query(
    "q_calibration_select",
    PM
    + """, m AS (SELECT action_id, CAST(count(*) AS BIGINT) AS window_count, CAST(count(*) FILTER (hard_slo_passed) AS BIGINT) AS hard_slo_pass_count,
    CAST(count(*) FILTER (deterministic_repetitions) AS BIGINT) AS deterministic_window_count,
    round(avg(allocation_rate_mean), 9) AS allocation_rate_mean, round(avg(spot_jct_p95_seconds), 9) AS spot_jct_p95_seconds,
    round(avg(spot_eviction_rate_per_run), 9) AS spot_eviction_rate_per_run
  FROM pm GROUP BY 1),
e AS (SELECT *, hard_slo_pass_count = window_count AND deterministic_window_count = window_count AS k0 FROM m),
e1 AS (SELECT *, k0 AND max(CASE WHEN k0 THEN allocation_rate_mean END) OVER () - allocation_rate_mean < 0.01 AS k1 FROM e),
e2 AS (SELECT *, k1 AND spot_jct_p95_seconds = min(CASE WHEN k1 THEN spot_jct_p95_seconds END) OVER () AS k2 FROM e1)
SELECT action_id, window_count, hard_slo_pass_count, deterministic_window_count, allocation_rate_mean, spot_jct_p95_seconds, spot_eviction_rate_per_run,
  coalesce(k2 AND spot_eviction_rate_per_run = min(CASE WHEN k2 THEN spot_eviction_rate_per_run END) OVER (), false) AS on_frontier FROM e2""",
)
def calibration_select(spark, sf_dir):
    return ranking.calibration_selection(policy_metrics(spark, sf_dir))


AUDIT_COLUMNS = "window_id, action_id, constraint_id, severity, round(observed, 6) AS observed, round(threshold, 6) AS threshold, status, passed"


def audited_metrics(spark, sf_dir):
    return audit.audit_constraints(policy_metrics(spark, sf_dir), WINDOW, carry=audit.EVIDENCE)


def _audit_rows(rows):
    return rows.select(
        "window_id",
        "action_id",
        "constraint_id",
        "severity",
        rounded(F.col("observed")).alias("observed"),
        rounded(F.col("threshold")).alias("threshold"),
        "status",
        "passed",
    )


@query("q_slo_audit", PM + "," + AUDIT + f"SELECT {AUDIT_COLUMNS} FROM aud")
def slo_audit(spark, sf_dir):
    return _audit_rows(audited_metrics(spark, sf_dir))


@query(
    "q_slo_audit_summary",
    PM
    + ","
    + AUDIT
    + """SELECT window_id, action_id, """
    + VERDICT
    + """ AS audit_passed,
  CAST(count(*) FILTER (severity = 'hard') AS BIGINT) AS hard_constraint_count,
  CAST(count(*) FILTER (severity <> 'hard' AND NOT passed) AS BIGINT) AS soft_violation_count,
  coalesce(string_agg(constraint_id, ',' ORDER BY constraint_id) FILTER (severity = 'hard' AND NOT passed), '') AS failed_hard_constraints
FROM aud GROUP BY 1, 2""",
)
def slo_audit_summary(spark, sf_dir):
    return audit.audit_summary(
        audited_metrics(spark, sf_dir), ["window_id", "action_id"]
    ).withColumn("failed_hard_constraints", F.array_join("failed_hard_constraints", ","))


@query(
    "q_candidate_audit",
    PM
    + ","
    + AUDIT
    + f""", {RELAXED}
SELECT window_id, action_id, constraint_id, severity, round(observed, 6) AS observed, round(threshold, 6) AS threshold,
  CASE WHEN vacuous THEN 'not_applicable_zero_population' WHEN waits THEN 'final_window_only' ELSE status END AS status,
  passed OR vacuous OR waits AS passed FROM rel""",
)
def candidate_audit(spark, sf_dir):
    return _audit_rows(audit.relax_for_candidates(audited_metrics(spark, sf_dir)))


def nested_reports(metrics):
    """The flat row as the nested report the metric paths address."""
    stats = lambda cls, kind: F.struct(
        F.col(f"{cls}_{kind}_mean_seconds").alias("mean"),
        *([F.col(f"{cls}_{kind}_p50_seconds").alias("p50")] if kind == "jct" else []),
        F.col(f"{cls}_{kind}_p95_seconds").alias("p95"),
    )
    hp = F.struct(
        F.col("hp_completion_rate").alias("completion_rate"),
        stats("hp", "jct").alias("jct_seconds"),
        stats("hp", "queue").alias("queue_seconds"),
        F.col("hp_preempted_job_count").alias("preempted_job_count"),
    )
    spot = F.struct(
        F.col("spot_completion_rate").alias("completion_rate"),
        stats("spot", "jct").alias("jct_seconds"),
        stats("spot", "queue").alias("queue_seconds"),
        F.col("spot_preemption_count").alias("preemption_count"),
        F.col("spot_preempted_job_rate").alias("preempted_job_rate"),
    )
    return metrics.select(
        "window_id",
        "action_id",
        F.struct(hp.alias("HP"), spot.alias("Spot")).alias("jobs"),
        F.struct("allocation_rate_mean").alias("cluster"),
        F.struct(
            F.col("spot_eviction_rate_per_run").alias("eviction_rate_per_run"),
            F.col("preemption_added_gpu_seconds").alias("added_gpu_seconds_total"),
        ).alias("preemption_events"),
        F.struct(F.col("spot_guarantee_success_rate").alias("success_rate")).alias(
            "spot_guarantee"
        ),
    )


DIRECTIONS = (
    "(VALUES "
    + ", ".join(f"('{m}', '{d}')" for m, (_, d) in audit.METRIC_CATALOG.items())
    + ") d(metric, preferred_direction)"
)


@query(
    "q_metric_catalog",
    PM
    + f""", {LONG}
SELECT window_id, action_id, metric, value, preferred_direction FROM long JOIN {DIRECTIONS} USING (metric)""",
)
def metric_catalog(spark, sf_dir):
    return audit.report_metrics(
        nested_reports(policy_metrics(spark, sf_dir)), ["window_id", "action_id"]
    )


SHARED_SQL = {
    "source_match": "source",
    "trace_id_match": "trace_id",
    "window_match": "(evaluation_start, evaluation_end)",
    "population_match": "(hp_job_count, spot_job_count)",
    "execution_controls_match": "controls",
}
OWN_SQL = {
    "metrics_schema_supported": "true",
    "metrics_fingerprints_valid": "evidence_valid",
    "populations_complete": "hp_completed_count = hp_job_count AND spot_completed_count = spot_job_count",
    "event_ledgers_available": "preemption_event_count IS NOT NULL",
    "run_ledgers_available": "spot_run_count IS NOT NULL",
    "guarantee_ledgers_available": "spot_run_count IS NOT NULL",
    "event_ledgers_consistent": "preemption_ledger_consistent",
    "run_ledgers_consistent": "run_ledger_consistent",
    "guarantee_ledgers_consistent": "guarantee_ledger_consistent",
}
EXECUTION = " ".join(
    f"WHEN '{p.action_id}' THEN '{'|'.join(str(getattr(p, c)) for c in compare.EXECUTION_CONTROLS)}'" for p in POLICIES.values()
)


def _criteria_sql(where: str, distinct: str) -> str:
    own = ", ".join(f"bool_and(coalesce({v}, false)) AS {n}" for n, v in OWN_SQL.items())
    shared = ", ".join(f"count(DISTINCT CAST({v} AS VARCHAR)) = 1 AND count(*) = count({v}) AS {n}" for n, v in SHARED_SQL.items())
    names = " AND ".join([*OWN_SQL, *SHARED_SQL, distinct])
    return f"""crit AS (SELECT *, {names} AS comparable FROM (SELECT window_id, {own}, {shared}, count(DISTINCT action_id) = count(*) AS {distinct}
  FROM (SELECT *, CASE action_id {EXECUTION} END AS controls FROM pm WHERE {where}) GROUP BY 1))"""


DELTAS = """a.metric, a.value AS left_value, b.value AS right_value, round(b.value - a.value, 6) + 0.0 AS right_minus_left,
  CASE WHEN a.value <> 0 THEN round((round(b.value - a.value, 6) + 0.0) / a.value, 6) + 0.0 END AS relative_to_left, d.preferred_direction"""
DELTA_JOINS = f"""JOIN long a ON a.window_id = l.window_id AND a.action_id = l.action_id
  JOIN long b ON b.window_id = r.window_id AND b.action_id = r.action_id AND b.metric = a.metric JOIN {DIRECTIONS} ON d.metric = a.metric"""


@query(
    "q_pairwise_deltas",
    PM
    + f""", {LONG}, {_criteria_sql("true", "policy_actions_unique")},
acts AS (SELECT unnest({list(MULTIWINDOW_ACTIONS)}) AS action_id, unnest(range({len(MULTIWINDOW_ACTIONS)})) AS i)
SELECT l.window_id, l.action_id AS left_action_id, r.action_id AS right_action_id, comparable, {DELTAS}
FROM pm l JOIN crit USING (window_id) JOIN acts la ON la.action_id = l.action_id
  JOIN pm r ON r.window_id = l.window_id JOIN acts ra ON ra.action_id = r.action_id AND la.i < ra.i {DELTA_JOINS}""",
)
def pairwise_deltas(spark, sf_dir):
    return compare.pairwise_deltas(policy_metrics(spark, sf_dir), MULTIWINDOW_ACTIONS)


@query(
    "q_compare",
    PM
    + f""", {LONG}, {_criteria_sql("action_id IN ('native-fifo', 'native-preemptive-3600')", "policy_actions_distinct")}
SELECT l.window_id, {", ".join([*OWN_SQL, *SHARED_SQL, "policy_actions_distinct", "comparable"])}, {DELTAS}
FROM pm l JOIN crit USING (window_id) JOIN pm r ON r.window_id = l.window_id AND l.action_id = 'native-fifo' AND r.action_id = 'native-preemptive-3600' {DELTA_JOINS}""",
)
def compare_pair(spark, sf_dir):
    return compare.compare_two(policy_metrics(spark, sf_dir), "native-fifo", "native-preemptive-3600")


PARTITIONED = """
days AS (SELECT window_id, CASE WHEN row_number() OVER (ORDER BY window_id) <= floor(count(*) OVER () * 0.6)
    THEN 'calibration' ELSE 'holdout' END AS partition FROM (SELECT DISTINCT window_id FROM pm)),
recs AS (SELECT based.*, partition FROM based JOIN days USING (window_id)),
fails AS (SELECT partition, action_id, constraint_id, count(*) AS n FROM aud JOIN days USING (window_id)
  WHERE severity = 'hard' AND NOT passed GROUP BY 1, 2, 3),
joined_fails AS (SELECT partition, action_id, string_agg(constraint_id || ':' || n, ',' ORDER BY constraint_id || ':' || n) AS f FROM fails GROUP BY 1, 2)
"""


@query(
    "q_partition_summary",
    PM
    + ","
    + BASED
    + ","
    + AUDIT
    + ","
    + PARTITIONED
    + f"""SELECT recs.partition, recs.action_id, {COUNTS}, {_spread_sql('allocation_rate_mean', 'allocation')}, {_spread_sql('delta', 'allocation_delta')},
  {_signs_sql('delta', 'allocation_delta')}, {_spread_sql('hp_jct_p95_seconds', 'hp_jct')}, {_spread_sql('spot_jct_p95_seconds', 'spot_jct')},
  {_spread_sql('spot_eviction_rate_per_run', 'eviction')}, {_spread_sql('spot_guarantee_success_rate', 'guarantee')},
  coalesce(any_value(f), '') AS failed_constraint_windows
FROM recs LEFT JOIN joined_fails j ON j.partition = recs.partition AND j.action_id = recs.action_id GROUP BY 1, 2""",
)
def partition_summary(spark, sf_dir):
    measured = partitioned(policy_metrics(spark, sf_dir))
    verdicts = verdicts_of(measured).join(measured.select("window_id", "partition").distinct(), "window_id")
    return ranking.partition_summary(measured, verdicts)


def partitioned(report):
    """The first three fifths of the windows calibrate, the rest are held out; windows are few."""
    ordered = Window.orderBy("window_id")
    cut = F.floor(F.count(F.lit(1)).over(Window.partitionBy()) * 0.6)
    days = report.select("window_id").distinct().select(
        "window_id", F.when(F.row_number().over(ordered) <= cut, "calibration").otherwise("holdout").alias("partition")
    )
    return report.join(days, "window_id")


def verdicts_of(report):
    audited = audit.audit_constraints(report.drop("partition"), WINDOW, carry=audit.EVIDENCE)
    return audit.audit_summary(audited, ["window_id", "action_id"])


@query("q_metric_snapshot", PM + f"SELECT window_id, action_id, {', '.join(audit.SNAPSHOT)} FROM pm")
def metric_snapshot(spark, sf_dir):
    return audit.metric_snapshot(policy_metrics(spark, sf_dir), ["window_id", "action_id"])


@query(
    "q_study_receipt",
    PM
    + f""", {AUDIT},
days AS (SELECT window_id, CASE WHEN row_number() OVER (ORDER BY window_id) <= floor(count(*) OVER () * 0.6)
    THEN 'calibration' ELSE 'holdout' END AS partition FROM (SELECT DISTINCT window_id FROM pm)),
m AS (SELECT action_id, count(*) FILTER (NOT hard_slo_passed OR NOT deterministic_repetitions) = 0 AS k0, round(avg(allocation_rate_mean), 9) AS a,
    round(avg(spot_jct_p95_seconds), 9) AS j, round(avg(spot_eviction_rate_per_run), 9) AS e FROM pm JOIN days USING (window_id) WHERE partition = 'calibration' GROUP BY 1),
m1 AS (SELECT *, k0 AND max(CASE WHEN k0 THEN a END) OVER () - a < 0.01 AS k1 FROM m),
m2 AS (SELECT *, k1 AND j = min(CASE WHEN k1 THEN j END) OVER () AS k2 FROM m1),
chosen AS (SELECT action_id FROM (SELECT *, coalesce(k2 AND e = min(CASE WHEN k2 THEN e END) OVER (), false) AS f FROM m2) WHERE f),
hold AS (SELECT action_id, bool_and(hard_slo_passed) AS stands FROM pm JOIN days USING (window_id) WHERE partition = 'holdout' GROUP BY 1),
tally AS (SELECT count(*) AS n, bool_and(coalesce(stands, false)) AS every FROM chosen LEFT JOIN hold USING (action_id)),
fails AS (SELECT window_id, action_id, coalesce(string_agg(constraint_id, ',' ORDER BY constraint_id) FILTER (severity = 'hard' AND NOT passed), '') AS failed_hard_constraints FROM aud GROUP BY 1, 2)
SELECT window_id, action_id, partition, hard_slo_passed, deterministic_repetitions, {', '.join(audit.SNAPSHOT)}, failed_hard_constraints,
  CASE WHEN tally.n = 0 THEN 'no_calibration_eligible_arm' WHEN NOT every THEN 'holdout_rejected' WHEN tally.n = 1 THEN 'holdout_passed'
    ELSE 'holdout_tie_requires_human_approval' END AS study_status
FROM pm JOIN days USING (window_id) JOIN fails USING (window_id, action_id), tally""",
)
def study_receipt(spark, sf_dir):
    measured = partitioned(policy_metrics(spark, sf_dir))
    selected = ranking.calibration_selection(measured.where("partition = 'calibration'")).where("on_frontier")
    receipt = ranking.study_receipt(measured, verdicts_of(measured), selected, audit.SNAPSHOT)
    return receipt.withColumn("failed_hard_constraints", F.array_join("failed_hard_constraints", ","))


ACTIVE = "CASE CAST(substr(window_id, 9, 2) AS INT) % 3 WHEN 0 THEN 'native-fifo' WHEN 1 THEN 'native-preemptive-3600' ELSE 'native-preemptive-g3600-b09-d0900' END"
CONTROLS = (
    "(VALUES "
    + ", ".join(
        "('" + a + "', " + ", ".join(f"'{getattr(POLICIES[a], f)}'" for f in ranking.CONTROL_FIELDS) + ")"
        for a in MULTIWINDOW_ACTIONS
    )
    + ") AS v(action_id, "
    + ", ".join(f"c{i}" for i in range(len(ranking.CONTROL_FIELDS)))
    + ")"
)
DISTANCE = " + ".join(
    f"CASE WHEN mine.c{i} <> act.c{i} THEN 1 ELSE 0 END" for i in range(len(ranking.CONTROL_FIELDS))
)


def rolling_candidates(spark, sf_dir):
    """The ledger's metrics with a currently active action, as a rolling decision sees them.

    A cutoff scenario judges only the constraints it can already see; the others wait.
    """
    day = F.substring("window_id", 9, 2).cast("int")
    report = policy_metrics(spark, sf_dir).drop("hard_slo_passed")
    relaxed = audit.relax_for_candidates(audit.audit_constraints(report, WINDOW, carry=audit.EVIDENCE))
    passed = relaxed.groupBy("window_id", "action_id").agg(F.bool_and(F.col("passed") | (F.col("severity") != "hard")).alias("hard_slo_passed"))
    return report.join(passed, ["window_id", "action_id"]).withColumn(
        "active_action_id",
        F.when(day % 3 == 0, "native-fifo")
        .when(day % 3 == 1, "native-preemptive-3600")
        .otherwise("native-preemptive-g3600-b09-d0900"),
    )


@query(
    "q_rolling_rank",
    PM
    + f""", {AUDIT}, {RELAXED}, {CANDIDATE_PASS}, cand AS (SELECT pm.window_id, pm.action_id, ok, allocation_rate_mean AS alloc,
    spot_jct_p95_seconds AS jct, spot_eviction_rate_per_run AS ev, stress_scenario_pass_count AS stress, {ACTIVE} AS active FROM pm JOIN cp USING (window_id, action_id)),
controls AS (SELECT * FROM {CONTROLS}),
k0 AS (SELECT *, ok AND alloc IS NOT NULL AS k FROM cand),
k1 AS (SELECT * EXCLUDE k, k AND max(CASE WHEN k THEN alloc END) OVER w - alloc < 0.01 AS k FROM k0 WINDOW w AS (PARTITION BY window_id)),
k2a AS (SELECT *, count(*) FILTER (k) OVER w AS c, min(CASE WHEN k THEN jct END) OVER w AS b FROM k1 WINDOW w AS (PARTITION BY window_id)),
k2 AS (SELECT * EXCLUDE (k, c, b), k AND (c = 1 OR b IS NULL OR coalesce(jct = b, false)) AS k FROM k2a),
k3a AS (SELECT *, count(*) FILTER (k) OVER w AS c, min(CASE WHEN k THEN ev END) OVER w AS b FROM k2 WINDOW w AS (PARTITION BY window_id)),
k3 AS (SELECT * EXCLUDE (k, c, b), k AND (c = 1 OR b IS NULL OR coalesce(ev = b, false)) AS k FROM k3a),
k4 AS (SELECT * EXCLUDE k, coalesce(k AND stress = max(CASE WHEN k THEN stress END) OVER w, false) AS k FROM k3 WINDOW w AS (PARTITION BY window_id)),
dist AS (SELECT k4.*, {DISTANCE} AS dist FROM k4 JOIN controls mine ON mine.action_id = k4.action_id JOIN controls act ON act.action_id = active),
near AS (SELECT *, min(CASE WHEN k THEN dist END) OVER w AS nd, bool_or(action_id = active) OVER w AS present FROM dist WINDOW w AS (PARTITION BY window_id)),
fin AS (SELECT window_id, any_value(active) AS active, count(*) FILTER (k) AS size, min(action_id) FILTER (k) AS first_id,
    coalesce(string_agg(action_id, ',' ORDER BY action_id) FILTER (k), '') AS frontier_action_ids,
    bool_or(k AND action_id = active) AS has_active, bool_or(k AND action_id = 'native-fifo') AS has_base,
    count(*) FILTER (k AND dist = nd AND present) AS near_count, min(action_id) FILTER (k AND dist = nd AND present) AS near_id FROM near GROUP BY 1)
SELECT window_id, frontier_action_ids,
  CASE WHEN size = 0 THEN 'native-fifo' WHEN size = 1 THEN first_id WHEN has_active THEN active WHEN near_count = 1 THEN near_id
    WHEN has_base THEN 'native-fifo' ELSE first_id END AS selected_action_id,
  CASE WHEN size = 0 THEN 'no_eligible_policy_safe_fifo' WHEN size = 1 THEN 'selected' WHEN NOT has_active AND near_count = 1
    THEN 'tie_resolved_by_minimum_control_change' ELSE 'tie_with_declared_safety_fallback' END AS selection_status FROM fin""",
)
def rolling_rank(spark, sf_dir):
    return ranking.rolling_selection(rolling_candidates(spark, sf_dir), WINDOW).withColumn(
        "frontier_action_ids", F.array_join("frontier_action_ids", ",")
    )


ARMS = f"""
arms AS (SELECT arm_id, CAST(count(*) AS BIGINT) AS window_count, CAST(count(*) FILTER (hard_slo_passed) AS BIGINT) AS hard_slo_pass_count,
    round(avg(allocation_rate_mean), 9) AS allocation_rate_mean, round(avg(spot_jct_p95_seconds), 9) AS spot_jct_p95_seconds,
    round(avg(spot_eviction_rate_per_run), 9) AS spot_eviction_rate_per_run,
    CAST(coalesce(sum(candidate_simulation_count), 0) AS BIGINT) AS candidate_simulation_count,
    CAST(coalesce(sum(llm_call_count), 0) AS BIGINT) AS llm_call_count FROM ar GROUP BY 1)
"""
LADDER = """WHEN abs(l.allocation_rate_mean - r.allocation_rate_mean) >= 0.01 AND l.allocation_rate_mean > r.allocation_rate_mean THEN 'better'
    WHEN abs(l.allocation_rate_mean - r.allocation_rate_mean) >= 0.01 THEN 'worse'
    WHEN l.spot_jct_p95_seconds < r.spot_jct_p95_seconds THEN 'better' WHEN l.spot_jct_p95_seconds > r.spot_jct_p95_seconds THEN 'worse'
    WHEN l.spot_eviction_rate_per_run < r.spot_eviction_rate_per_run THEN 'better'
    WHEN l.spot_eviction_rate_per_run > r.spot_eviction_rate_per_run THEN 'worse' ELSE 'tie' END"""
COMPARED = f"""
cmp AS (SELECT r.arm_id AS comparator_arm_id, CASE WHEN l.hard_slo_pass_count > r.hard_slo_pass_count THEN 'better'
    WHEN l.hard_slo_pass_count < r.hard_slo_pass_count THEN 'worse' {LADDER} AS verdict,
    l.hard_slo_pass_count >= r.hard_slo_pass_count AS no_fewer_passes,
    l.candidate_simulation_count = r.candidate_simulation_count AS equal_simulation_budget,
    l.llm_call_count = r.llm_call_count AS equal_call_budget, l.window_count = r.window_count AS equal_windows
  FROM arms l JOIN arms r ON l.arm_id = 'rolling-multi-agent' AND r.arm_id <> l.arm_id)
"""


@query("q_arm_aggregate", AR + "," + ARMS + "SELECT * FROM arms")
def arm_aggregate(spark, sf_dir):
    return ranking.arm_aggregate(arm_records(policy_metrics(spark, sf_dir)))


@query("q_arm_compare", AR + "," + ARMS + "," + COMPARED + "SELECT * FROM cmp")
def arm_compare(spark, sf_dir):
    return ranking.arm_comparisons(arm_aggregate(spark, sf_dir))


@query(
    "q_claim_gate",
    AR
    + ","
    + ARMS
    + ","
    + COMPARED
    + """SELECT CASE WHEN (SELECT count(*) FROM cmp WHERE comparator_arm_id IN ('ordinary-fifo', 'fixed-tenant-predictive', 'rolling-workload-rule', 'rolling-single-agent')) < 4 THEN 'incomplete'
  WHEN (SELECT count(*) FROM cmp WHERE comparator_arm_id <> 'posthoc-catalog-oracle' AND NOT no_fewer_passes) = 0
   AND (SELECT count(*) FROM cmp WHERE comparator_arm_id LIKE 'rolling-%' AND NOT (equal_simulation_budget AND verdict = 'better')) = 0
  THEN 'supported' ELSE 'not_established' END AS superiority_gate,
 CASE (SELECT verdict FROM cmp WHERE comparator_arm_id = 'ordinary-fifo') WHEN 'better' THEN 'supported' ELSE 'not_established' END AS ordinary_gate,
 CASE WHEN (SELECT count(*) FROM cmp WHERE comparator_arm_id = 'rolling-multi-agent-masked' AND verdict = 'better' AND equal_windows
   AND equal_simulation_budget AND equal_call_budget) = 1 THEN 'supported' ELSE 'not_established' END AS causal_gate""",
)
def claim_gate(spark, sf_dir):
    return ranking.claim_gates(arm_compare(spark, sf_dir))


@query(
    "q_closeout",
    AR
    + ","
    + ARMS.replace("FROM ar GROUP", "FROM ar WHERE feasible GROUP")
    + f""", el AS (SELECT * FROM arms WHERE arm_id <> 'posthoc-catalog-oracle' AND hard_slo_pass_count = window_count),
duel AS (SELECT l.arm_id, r.arm_id AS rival, CASE WHEN l.arm_id <> r.arm_id THEN CASE {LADDER} END AS v FROM el l CROSS JOIN el r),
tally AS (SELECT arm_id, CAST(count(*) FILTER (v = 'better') AS BIGINT) AS wins, CAST(count(*) FILTER (v = 'worse') AS BIGINT) AS losses,
  CAST(count(*) FILTER (v = 'tie') AS BIGINT) AS ties FROM duel GROUP BY 1),
placed AS (SELECT *, row_number() OVER o AS position, lead(arm_id) OVER o AS second FROM tally WINDOW o AS (ORDER BY wins - losses DESC, arm_id))
SELECT arm_id, wins, losses, ties, position,
  position = 1 AND coalesce((SELECT v <> 'tie' FROM duel d WHERE d.arm_id = placed.arm_id AND d.rival = placed.second), true) AS recommended FROM placed""",
)
def closeout(spark, sf_dir):
    """Over the windows that some action passes: where none does, no arm can be told from another."""
    records = arm_records(policy_metrics(spark, sf_dir)).where("feasible")
    return ranking.closeout(ranking.arm_aggregate(records))


RULE = """
med AS (SELECT quantile_cont(combined_peak_active_pressure, 0.5) AS p, quantile_cont(spot_requested_gpu_share, 0.5) AS s
  FROM split WHERE partition = 'calibration'),
rule AS (SELECT date AS window_id, CASE WHEN combined_peak_active_pressure >= p AND spot_requested_gpu_share >= s THEN 'high-pressure-high-spot-share'
    WHEN combined_peak_active_pressure >= p THEN 'high-pressure-lower-spot-share'
    WHEN spot_requested_gpu_share >= s THEN 'lower-pressure-high-spot-share' ELSE 'lower-pressure-lower-spot-share' END AS reason_code
  FROM split, med WHERE partition = 'evaluation'),
rc AS (SELECT window_id, reason_code, CASE reason_code
    WHEN 'high-pressure-high-spot-share' THEN ['native-fifo', 'native-preemptive-g3600-b09-d0000', 'native-preemptive-g3600-b09-loss-aware']
    WHEN 'high-pressure-lower-spot-share' THEN ['native-fifo', 'native-preemptive-3600', 'native-preemptive-g3600-b09-d0000']
    WHEN 'lower-pressure-high-spot-share' THEN ['native-fifo', 'native-preemptive-g3600-b09-d0900', 'native-preemptive-g3600-b09-loss-aware']
    ELSE ['native-fifo', 'native-preemptive-g3600-b09-d0000', 'native-preemptive-g3600-b09-d0900'] END AS cands FROM rule)
"""


@query(
    "q_rule_controller",
    "WITH "
    + TRACE_CTES
    + SPLIT
    + ","
    + RULE
    + "SELECT window_id, reason_code, array_to_string(cands, ',') AS candidate_action_ids FROM rc",
)
def rule_controller(spark, sf_dir):
    return ranking.rule_controller(split_windows(spark, sf_dir)).withColumn(
        "candidate_action_ids", F.array_join("candidate_action_ids", ",")
    )


def _frontier_sql(prefix: str, eligible: str, source: str) -> str:
    p = prefix
    return f"""
{p}1 AS (SELECT *, {eligible} AS {p}0, max(CASE WHEN {eligible} THEN allocation_rate_mean END) OVER (PARTITION BY window_id) AS {p}ba FROM {source}),
{p}2 AS (SELECT *, {p}0 AND {p}ba - allocation_rate_mean < 0.01 AS {p}k1 FROM {p}1),
{p}3 AS (SELECT *, {p}k1 AND spot_jct_p95_seconds = min(CASE WHEN {p}k1 THEN spot_jct_p95_seconds END) OVER (PARTITION BY window_id) AS {p}k2 FROM {p}2),
{p}4 AS (SELECT *, coalesce({p}k2 AND spot_eviction_rate_per_run = min(CASE WHEN {p}k2 THEN spot_eviction_rate_per_run END) OVER (PARTITION BY window_id), false) AS {p}f FROM {p}3)"""


def _r9(value: str, name: str) -> str:
    return f"round({value}, 9) + 0.0 AS {name}"


@query(
    "q_controller_benchmark",
    PM
    + ","
    + TRACE_CTES
    + SPLIT
    + ","
    + RULE
    + ", src AS (SELECT pm.*, reason_code, cands, list_contains(cands, action_id) AS cand FROM pm JOIN rc USING (window_id)),"
    + _frontier_sql("m", "(hard_slo_passed AND cand)", "src")
    + ","
    + _frontier_sql("o", "hard_slo_passed", "m4")
    + f""", w AS (SELECT window_id, len(any_value(cands)) AS cc, count(*) AS catalog,
    count(*) FILTER (mf) AS mine, count(*) FILTER (of) AS orc, count(*) FILTER (mf AND of) AS common,
    max(allocation_rate_mean) FILTER (hard_slo_passed AND cand) AS bc, max(allocation_rate_mean) FILTER (hard_slo_passed) AS bo,
    max(allocation_rate_mean) FILTER (action_id = 'native-fifo') AS fa, max(spot_jct_p95_seconds) FILTER (action_id = 'native-fifo') AS fj,
    max(spot_eviction_rate_per_run) FILTER (action_id = 'native-fifo') AS fe,
    min(allocation_rate_mean) FILTER (mf) AS smin, max(allocation_rate_mean) FILTER (mf) AS smax,
    min(spot_jct_p95_seconds) FILTER (mf) AS sj, min(spot_eviction_rate_per_run) FILTER (mf) AS se FROM o4 GROUP BY 1),
x AS (SELECT *, common > 0 AS covered, orc > 0 AND mine = orc AND common = orc AS exact,
    CASE WHEN bc IS NOT NULL AND bo IS NOT NULL THEN greatest(0.0::DOUBLE, bo - bc) END AS regret, bc - fa AS up,
    smin - fa AS lo, smax - fa AS hi, sj - fj AS dj, se - fe AS de FROM w)
SELECT CAST(count(*) AS BIGINT) AS evaluation_window_count, CAST(count(*) FILTER (mine > 0) AS BIGINT) AS hard_slo_feasible_window_count,
  CAST(count(bo) AS BIGINT) AS oracle_feasible_window_count, CAST(count(*) FILTER (covered) AS BIGINT) AS coverage_window_count,
  CASE WHEN count(bo) > 0 THEN round(count(*) FILTER (covered) / count(bo)::DOUBLE, 9) END AS coverage_rate,
  CAST(count(*) FILTER (exact) AS BIGINT) AS exact_match_window_count,
  CASE WHEN count(bo) > 0 THEN round(count(*) FILTER (exact) / count(bo)::DOUBLE, 9) END AS exact_match_rate,
  CAST(sum(cc) AS BIGINT) AS candidate_evaluation_count, {_r9('avg(cc)', 'candidate_count_mean')},
  {_r9('1 - sum(cc) / sum(catalog)::DOUBLE', 'evaluation_reduction')},
  CAST(count(*) FILTER (mine = 1) AS BIGINT) AS selected_windows, CAST(count(*) FILTER (mine > 1) AS BIGINT) AS tied_windows,
  CAST(count(*) FILTER (mine = 0) AS BIGINT) AS empty_windows, {_r9('avg(lo)', 'uplift_mean_lower')}, {_r9('avg(hi)', 'uplift_mean_upper')},
  {_r9('max(hi)', 'uplift_max_upper')}, {_signs_sql('lo', 'uplift_lower', '1e-12')},
  {_r9('avg(dj)', 'jct_delta_mean')}, {_r9('quantile_cont(dj, 0.95)', 'jct_delta_p95')}, {_r9('min(dj)', 'jct_delta_min')}, {_r9('max(dj)', 'jct_delta_max')},
  {_r9('avg(de)', 'eviction_delta_mean')}, {_r9('quantile_cont(de, 0.95)', 'eviction_delta_p95')},
  CAST(count(*) FILTER (regret <= 1e-12) AS BIGINT) AS best_allocation_covered_windows,
  CASE WHEN count(bo) > 0 THEN round(count(*) FILTER (regret <= 1e-12) / count(bo)::DOUBLE, 9) END AS best_allocation_covered_rate,
  {_r9('avg(regret)', 'regret_mean')}, {_r9('quantile_cont(regret, 0.95)', 'regret_p95')}, {_r9('max(regret)', 'regret_max')},
  {_r9('avg(up)', 'candidate_uplift_mean')}, {_r9('quantile_cont(up, 0.95)', 'candidate_uplift_p95')}, {_r9('max(up)', 'candidate_uplift_max')},
  {_signs_sql('up', 'candidate_uplift', '1e-12')} FROM x""",
)
def controller_benchmark(spark, sf_dir):
    controller = ranking.rule_controller(split_windows(spark, sf_dir))
    return ranking.controller_summary(
        ranking.controller_windows(policy_metrics(spark, sf_dir), controller)
    )


@query(
    "q_study_validate",
    "WITH "
    + TRACE_CTES
    + SPLIT
    + f""", l AS (SELECT *, lag(start_seconds) OVER o AS prev, lag(partition) OVER o AS pp, count(*) OVER (PARTITION BY date) AS same
  FROM split WINDOW o AS (ORDER BY start_seconds))
SELECT 'not_chronological' AS rule, CAST(count(*) FILTER (start_seconds <= prev) AS BIGINT) AS violation_count FROM l
UNION ALL SELECT 'wrong_size', count(*) FILTER (end_seconds - start_seconds + 1 <> 86400) FROM l
UNION ALL SELECT 'too_little_history', count(*) FILTER (start_seconds < {5 * DAY}) FROM l
UNION ALL SELECT 'repeated_date', count(*) FILTER (same > 1) FROM l
UNION ALL SELECT 'calibration_after_evaluation', count(*) FILTER (partition = 'calibration' AND pp = 'evaluation') FROM l
UNION ALL SELECT 'unknown_partition', count(*) FILTER (partition NOT IN ('calibration', 'evaluation')) FROM l""",
)
def study_validate(spark, sf_dir):
    windows = split_windows(spark, sf_dir).withColumn("position", F.col("start_seconds"))
    return ranking.study_violations(
        windows, window_seconds=DAY, minimum_history_seconds=5.0 * DAY
    )


def robust_evidence(spark, sf_dir):
    """Scenario evidence per three-day decision: two decision scenarios and one stress scenario."""
    day = F.substring("window_id", 9, 2).cast("int")
    return rolling_candidates(spark, sf_dir).withColumns(
        {
            "decision_id": F.floor((day - 1) / 3).cast("long"),
            "selection_role": F.when((day - 1) % 3 == 2, "stress").otherwise("decision"),
            "projected_hp_queue_p95": F.col("hp_queue_p95_seconds"),
        }
    )


@query(
    "q_robust_candidates",
    PM
    + f""", {AUDIT}, {RELAXED}, {CANDIDATE_PASS}, g AS (SELECT pm.*, ok, coalesce(hp_queue_p95_seconds <= 3600 + 1e-9, true) AS guard,
    (CAST(substr(window_id, 9, 2) AS INT) - 1) // 3 AS decision_id,
    CASE WHEN (CAST(substr(window_id, 9, 2) AS INT) - 1) % 3 = 2 THEN 'stress' ELSE 'decision' END AS role FROM pm JOIN cp USING (window_id, action_id))
SELECT CAST(decision_id AS BIGINT) AS decision_id, action_id,
  coalesce(bool_and(ok AND guard) FILTER (role = 'decision'), true) AS hard_slo_passed,
  CAST(count(*) FILTER (role = 'stress' AND ok AND guard) AS BIGINT) AS stress_scenario_pass_count,
  CAST(count(*) FILTER (role = 'stress') AS BIGINT) AS stress_scenario_count,
  min(allocation_rate_mean) FILTER (role = 'decision') AS allocation_rate_mean,
  max(hp_jct_p95_seconds) FILTER (role = 'decision') AS hp_jct_p95_seconds,
  max(hp_queue_p95_seconds) FILTER (role = 'decision') AS hp_queue_p95_seconds,
  max(spot_jct_p95_seconds) FILTER (role = 'decision') AS spot_jct_p95_seconds,
  max(spot_eviction_rate_per_run) FILTER (role = 'decision') AS spot_eviction_rate_per_run
FROM g GROUP BY 1, 2""",
)
def robust_candidates(spark, sf_dir):
    from ..operators.rolling import robust_candidates as combine

    return combine(robust_evidence(spark, sf_dir), ["decision_id"])
