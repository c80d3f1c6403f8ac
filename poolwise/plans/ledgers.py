"""Registered queries over the run ledger laid out from every line of every order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import fingerprints, metrics
from ..sources.ledger import LEDGER_CTES, class_report, ledger_capacity, ledger_windows, run_ledger
from .registry import query

WITH = "WITH " + LEDGER_CTES


@query(
    "q_metrics_by_class",
    WITH
    + """SELECT run_id, action_id, service_class, job_count, completed_count, completion_rate,
  round(jct_mean, 4) + 0.0 AS jct_mean_seconds, jct_p50 + 0.0 AS jct_p50_seconds, jct_p95 + 0.0 AS jct_p95_seconds, round(queue_mean, 4) + 0.0 AS queue_mean_seconds,
  queue_p50 + 0.0 AS queue_p50_seconds, queue_p95 + 0.0 AS queue_p95_seconds, preemption_count, preempted_job_count, preempted_job_rate, run_count FROM cm""",
)
def metrics_by_class(spark, sf_dir):
    report = class_report(spark, sf_dir)
    return report.withColumns({c: rounded(F.col(c), 4) for c in ("jct_mean_seconds", "queue_mean_seconds")})


@query("q_spot_metrics", WITH + "SELECT * FROM sm")
def spot_metrics(spark, sf_dir):
    return metrics.spot_metrics(run_ledger(spark, sf_dir), ledger_windows(spark))


@query(
    "q_allocation_rate",
    WITH
    + """SELECT run_id, action_id, round(total, 1) AS allocated_gpu_seconds, round(warm, 1) AS warmup_allocated_gpu_seconds, round(ins, 1) AS evaluation_allocated_gpu_seconds,
  round(total - warm - ins, 1) AS drain_allocated_gpu_seconds, round(ins / (gpus * (ee - es)), 6) AS allocation_rate_mean FROM al, cap_l""",
)
def allocation_rate(spark, sf_dir):
    capacity = F.lit(ledger_capacity(spark, sf_dir))
    report = metrics.allocation(run_ledger(spark, sf_dir), ledger_windows(spark), capacity)
    work = {c: rounded(F.col(c), 1) for c in report.columns if c.endswith("gpu_seconds")}
    return report.withColumns({**work, "allocation_rate_mean": rounded(F.col("allocation_rate_mean"))})


@query(
    "q_feedback_weights",
    WITH
    + """, f AS (SELECT run_id, action_id, gpu_model, node_count, CASE WHEN guarantee_seconds > 0 THEN CAST(floor((e - s + 1e-9) / guarantee_seconds) AS BIGINT) ELSE 0 END AS k,
    CASE WHEN end_reason = 'preempted' THEN 'preempted' ELSE 'job_completed' END AS ended FROM runs WHERE service_class = 'Spot')
SELECT run_id, action_id, gpu_model, 'guarantee_duration_completed' AS event_kind, CAST(sum(k) AS BIGINT) AS event_count, CAST(sum(k * node_count) AS DOUBLE) AS weight
  FROM f WHERE k > 0 GROUP BY 1, 2, 3
UNION ALL SELECT run_id, action_id, gpu_model, ended, count(*), CAST(sum(node_count) AS DOUBLE) FROM f GROUP BY 1, 2, 3, 4""",
)
def feedback_weights(spark, sf_dir):
    return metrics.feedback_events(run_ledger(spark, sf_dir))


@query(
    "q_eval_spot_ledger",
    WITH
    + """SELECT run_id, action_id, gpu_model, count(DISTINCT job_id) AS spot_jobs, count(*) AS spot_runs, count(*) FILTER (end_reason = 'preempted') AS preempted_runs
FROM re WHERE service_class = 'Spot' GROUP BY 1, 2, 3""",
)
def eval_spot_ledger(spark, sf_dir):
    mine = metrics.evaluated_spot(run_ledger(spark, sf_dir), ledger_windows(spark))
    return mine.groupBy("run_id", "action_id", "gpu_model").agg(
        F.countDistinct("job_id").alias("spot_jobs"),
        F.count(F.lit(1)).alias("spot_runs"),
        F.count_if(F.col("end_reason") == "preempted").alias("preempted_runs"),
    )


@query(
    "q_guarantee_check",
    WITH
    + """SELECT run_id, action_id, count(*) FILTER (end_reason <> 'preempted') AS ended_spot_runs, count(*) FILTER (end_reason = 'preempted') AS preempted_spot_runs,
  count(*) FILTER (end_reason <> 'completed' AND e - s + 1e-9 < guarantee_seconds) AS broken_guarantees FROM runs WHERE service_class = 'Spot' GROUP BY 1, 2""",
)
def guarantee_check(spark, sf_dir):
    hit = F.col("end_reason") == "preempted"
    return metrics.spot_run_ledger(run_ledger(spark, sf_dir)).groupBy("run_id", "action_id").agg(
        F.count_if(~hit).alias("ended_spot_runs"),
        F.count_if(hit).alias("preempted_spot_runs"),
        F.count_if(~F.col("guarantee_succeeded")).alias("broken_guarantees"),
    )


@query(
    "q_rollback_check",
    WITH
    + """SELECT run_id, action_id, count(*) FILTER (end_reason = 'preempted') AS preempted_runs,
  count(*) FILTER (end_reason = 'preempted' AND abs(rollback_seconds - (e - s) % 3600.0::DOUBLE) > 1e-6) AS wrong_rollbacks,
  count(*) FILTER (end_reason = 'preempted' AND overhead_seconds <> 80) AS wrong_overheads,
  count(*) FILTER (end_reason = 'preempted' AND trigger_id IS NULL) AS missing_triggers FROM runs GROUP BY 1, 2""",
)
def rollback_check(spark, sf_dir):
    hit = F.col("end_reason") == "preempted"
    wrong = F.abs(F.col("rollback_seconds") - metrics.run_seconds() % 3600.0) > 1e-6
    return run_ledger(spark, sf_dir).groupBy("run_id", "action_id").agg(
        F.count_if(hit).alias("preempted_runs"),
        F.count_if(hit & wrong).alias("wrong_rollbacks"),
        F.count_if(hit & (F.col("overhead_seconds") != 80.0)).alias("wrong_overheads"),
        F.count_if(hit & F.col("trigger_id").isNull()).alias("missing_triggers"),
    )


@query(
    "q_preemption_ledger",
    WITH
    + """SELECT run_id, action_id, e AS time_seconds, job_id AS preempted_job_id, trigger_id AS triggering_job_id, rollback_seconds, overhead_seconds,
  (rollback_seconds + overhead_seconds) * gpu_count AS added_gpu_seconds FROM runs WHERE trigger_id IS NOT NULL""",
)
def preemption_ledger(spark, sf_dir):
    return metrics.preemption_ledger(run_ledger(spark, sf_dir))


@query(
    "q_eviction_budget",
    WITH
    + """SELECT run_id, action_id, spot_run_count, preemption_event_count, preemption_event_count / spot_run_count::DOUBLE <= 0.09 + 1e-9 AS within_budget FROM sm""",
)
def eviction_budget(spark, sf_dir):
    counted = metrics.spot_metrics(run_ledger(spark, sf_dir), ledger_windows(spark))
    share = F.col("preemption_event_count") / F.col("spot_run_count")
    return counted.select(
        "run_id", "action_id", "spot_run_count", "preemption_event_count", (share <= 0.09 + 1e-9).alias("within_budget")
    )


def _part_sql(text: str, k: int) -> str:
    return f"('0x' || substr(sha256({text}), {1 + k * fingerprints.PART_DIGITS}, {fingerprints.PART_DIGITS}))::BIGINT"


def canonical_sql(values: dict[str, str]) -> str:
    shown = "CASE WHEN ({v}) IS NULL THEN '-' ELSE length(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END"
    return " || ".join(f"'{name}=' || {shown.format(v=v)} || ';'" for name, v in values.items())


def _fingerprint_sql(text: str) -> str:
    sums = " || ':' || ".join(f"CAST(sum({text}{k}::HUGEINT) AS VARCHAR)" for k in range(2))
    ors = " || ':' || ".join(f"CAST(bit_xor({text}{k}) AS VARCHAR)" for k in range(2))
    return f"sha256(count(*) || ':' || {sums} || ':' || {ors})"


_SHARED = {
    "job": "job_id", "ordinal": "run_ordinal", "start": "CAST(round(s * 1000) AS BIGINT)", "reason": "end_reason", "trigger": "trigger_id",
    "rollback": "CAST(round(rollback_seconds * 1000) AS BIGINT)",
}
_END = "CAST(round((e{shift}) * 1000) AS BIGINT)"
_FIRST = canonical_sql(_SHARED | {"end": _END.format(shift="")})
_SECOND = canonical_sql(_SHARED | {"end": _END.format(shift=" + CASE WHEN l_orderkey % 5003 = 17 * i THEN 1 ELSE 0 END")})


@query(
    "q_repetition_fingerprints",
    WITH
    + f""", tx AS (SELECT run_id, action_id, {_FIRST} AS a, {_SECOND} AS b FROM runs),
hx AS (SELECT run_id, action_id, {_part_sql('a', 0)} AS a0, {_part_sql('a', 1)} AS a1, {_part_sql('b', 0)} AS b0, {_part_sql('b', 1)} AS b1 FROM tx),
fp AS (SELECT run_id, action_id, count(*) AS row_count, {_fingerprint_sql('a')} AS primary_fingerprint, {_fingerprint_sql('b')} AS repeated_fingerprint FROM hx GROUP BY 1, 2)
SELECT *, CASE WHEN primary_fingerprint = repeated_fingerprint THEN 1 ELSE 2 END::BIGINT AS distinct_fingerprints, primary_fingerprint = repeated_fingerprint AS fingerprints_match FROM fp""",
)
def repetition_fingerprints(spark, sf_dir):
    """Whether both repetitions of each (window, action) have the same run rows, in whatever order."""
    ms = fingerprints.thousandths
    shared = {
        "job": F.col("job_id"),
        "ordinal": F.col("run_ordinal"),
        "start": ms(F.col("start_time_seconds")),
        "reason": F.col("end_reason"),
        "trigger": F.col("trigger_id"),
        "rollback": ms(F.col("rollback_seconds")),
    }
    ends = {"primary": {"end": ms(F.col("end_time_seconds"))}, "repeated": {"end": ms(F.col("repeated_end_seconds"))}}
    return fingerprints.repetition_fingerprints(run_ledger(spark, sf_dir), ["run_id", "action_id"], shared, ends)
