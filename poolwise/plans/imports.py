"""Registered importer queries; their raw tables are laid out from every row of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import DAY
from ..functions import rounded
from ..session import shared_path
from ..sources import importers
from ..sources.json_array import read_json_array, write_json_arrays
from ..sources.tables import jobs_from_events, table
from .registry import query

WARMUP, EVAL_START, EVAL_END = 2.0 * DAY, 5.0 * DAY, 20.0 * DAY - 1


def raw_spot_gpu_jobs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    jobs = jobs_from_events(events.select("event_id", "ts", "user_id", "event_type", "value", "props"))
    workers = F.substring("job_id", 2, 9).cast("long") % 3 + 1
    return jobs.select(
        F.concat(F.lit(" "), "job_id").alias("job_name"),
        F.concat("tenant_id", F.lit(" ")).alias("organization"),
        "gpu_model",
        F.col("gpu_count").cast("string").alias("gpu_request"),
        workers.cast("string").alias("worker_num"),
        F.col("submit_time_seconds").cast("string").alias("submit_time"),
        F.col("duration_seconds").cast("string").alias("duration"),
        F.concat(F.lit(" "), "service_class").alias("job_type"),
    )


RAW = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0::DOUBLE AS s FROM events)
"""


@query(
    "q_import_filter_project",
    RAW
    + f"""SELECT 'j' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS job_id, s AS submit_time_seconds,
  60.0::DOUBLE + CAST(floor(value * 300.0::DOUBLE) AS DOUBLE) AS duration_seconds,
  (event_id % 3 + 1) * CASE k % 5 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1::DOUBLE WHEN 2 THEN 1::DOUBLE WHEN 3 THEN 2::DOUBLE ELSE 4::DOUBLE END AS gpu_count,
  CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'HP' ELSE 'Spot' END AS service_class, 'A' AS gpu_model,
  't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id
FROM e WHERE user_id % 3 < 2 AND s <= {EVAL_END} AND s >= {WARMUP}
  AND NOT (event_type NOT IN ('purchase', 'signup', 'error') AND s < {EVAL_START})""",
)
def import_filter_project(spark, sf_dir):
    return importers.spot_gpu_jobs(
        raw_spot_gpu_jobs(spark, sf_dir),
        gpu_models={"A"},
        max_submit=EVAL_END,
        warmup_start=WARMUP,
        evaluation_start=EVAL_START,
        include_warmup_spot=False,
    )


def raw_pods(spark, sf_dir):
    """Every event as a pod, with each way of being unusable represented."""
    # Generated rather than projected, so that the JSON is parsed once per row and not per use.
    parsed = F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("k")
    events = table(spark, sf_dir, "events").select("*", parsed)
    k = F.col("k")
    seconds = F.expr(
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 1000000D"
    )
    queued = (F.col("user_id") % 50).cast("double")
    ran = F.when(k % 17 == 0, -1.0).otherwise(60.0 + F.floor(F.col("value") * 300.0))
    scheduled = seconds + queued
    return events.select(
        F.concat(F.lit("p"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(" ")).alias("name"),
        F.lit("1000").alias("cpu_milli"),
        F.lit("1024").alias("memory_mib"),
        F.when(k % 5 == 0, 0).when(k % 2 == 0, 1).otherwise(k % 5).cast("string").alias("num_gpu"),
        F.when(k % 12 == 0, 0).otherwise(k * 10).cast("string").alias("gpu_milli"),
        F.lit("").alias("gpu_spec"),
        F.when(F.col("event_type").isin("purchase", "signup"), "LS")
        .when(F.col("event_type") == "click", "Burstable")
        .otherwise("BE")
        .alias("qos"),
        F.when(k % 7 == 0, "Pending")
        .when(k % 7 == 1, "Failed")
        .when(k % 7 == 2, "Succeeded")
        .otherwise("Running")
        .alias("pod_phase"),
        seconds.cast("string").alias("creation_time"),
        (scheduled + ran).cast("string").alias("deletion_time"),
        F.when(k % 13 == 0, "").otherwise(scheduled.cast("string")).alias("scheduled_time"),
    )


PODS = (
    RAW
    + """, p AS (SELECT event_id, k, s, user_id % 50 AS q, CASE WHEN k % 17 = 0 THEN -1.0::DOUBLE ELSE 60.0::DOUBLE + floor(value * 300.0::DOUBLE) END AS ran,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'LS' WHEN event_type = 'click' THEN 'Burstable' ELSE 'BE' END AS qos,
    CASE WHEN k % 5 = 0 THEN 0 WHEN k % 2 = 0 THEN 1 ELSE k % 5 END AS num, CASE WHEN k % 12 = 0 THEN 0 ELSE k * 10 END AS milli FROM e),
c AS (SELECT *, CASE WHEN num = 1 THEN milli / 1000.0::DOUBLE ELSE num END AS req,
    (s + q) + ran - (s + q) AS dur,
    CASE WHEN qos = 'Burstable' THEN 'unsupported_qos' WHEN k % 7 = 0 THEN 'excluded_phase' WHEN num <= 0 THEN 'no_gpu'
      WHEN k % 13 = 0 OR ran < 0 THEN 'missing_or_invalid_interval'
      WHEN CASE WHEN num = 1 THEN milli / 1000.0::DOUBLE ELSE num END <= 0 THEN 'no_gpu' END AS reason FROM p)
"""
)


@query(
    "q_import_qos_skips",
    PODS
    + """SELECT r AS skip_reason, CAST((SELECT count(*) FROM c WHERE reason = r) AS BIGINT) AS pod_count
FROM (SELECT unnest(['unsupported_qos', 'excluded_phase', 'no_gpu', 'missing_or_invalid_interval']) AS r)""",
)
def import_qos_skips(spark, sf_dir):
    return importers.skipped_pods(importers.classify_pods(raw_pods(spark, sf_dir)))


@query(
    "q_import_qos_jobs",
    PODS
    + """, kept AS (SELECT * FROM c WHERE reason IS NULL)
SELECT 'p' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS job_id, round(s - (SELECT min(s) FROM kept), 6) AS submit_time_seconds, round(dur, 6) AS duration_seconds,
  round(req, 6) AS gpu_count, CASE qos WHEN 'LS' THEN 'HP' ELSE 'Spot' END AS service_class, '*' AS gpu_model FROM kept""",
)
def import_qos_jobs(spark, sf_dir):
    jobs = importers.qos_jobs(importers.classify_pods(raw_pods(spark, sf_dir)))
    return jobs.withColumns(
        {c: rounded(F.col(c)) for c in ("submit_time_seconds", "duration_seconds", "gpu_count")}
    )


def attempt_log(spark, sf_dir):
    """Every order as an attempt-log record, passed through its JSON text."""
    orders = table(spark, sf_dir, "orders")
    placed = F.col("o_orderdate").cast("timestamp_ntz")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    seconds = F.floor("o_totalprice").cast("int")

    def shifted(offset):
        return F.timestamp_add("SECOND", offset, placed)

    def text(moment):
        return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")

    def gpus(count):
        return F.struct(
            F.lit("10.0.0.1").alias("ip"), F.array_repeat(F.lit("gpu0"), count.cast("int")).alias("gpus")
        )

    first = F.struct(
        text(placed).alias("start_time"),
        text(shifted(seconds)).alias("end_time"),
        F.array(gpus(customer % 4), gpus(key % 3)).alias("detail"),
    )
    second = F.struct(
        F.when(customer % 5 == 0, "None").otherwise(text(shifted(F.lit(86400)))).alias("start_time"),
        text(shifted(F.lit(86400) + seconds % 1000 - 300)).alias("end_time"),
        F.array(gpus(customer % 8)).alias("detail"),
    )
    record = F.struct(
        key.cast("string").alias("jobid"),
        F.when(key % 50 == 0, "None").otherwise(text(placed)).alias("submitted_time"),
        F.array(first, second).alias("attempts"),
    )
    parsed = F.from_json(F.to_json(record), importers.ATTEMPT_LOG).alias("r")
    return orders.select(parsed).select("r.*")


ATTEMPTS = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, CAST(floor(o_totalprice) AS BIGINT) AS sec FROM orders),
a AS (SELECT k, d, k % 50 <> 0 AS has, sec > 0 AS v1, sec AS s1, c % 4 + k % 3 AS g1,
    c % 5 <> 0 AND sec % 1000 - 300 > 0 AS v2, sec % 1000 - 300 AS s2, c % 8 AS g2 FROM o),
m AS (SELECT *, (CASE WHEN v1 THEN s1 ELSE 0 END + CASE WHEN v2 THEN s2 ELSE 0 END)::DOUBLE AS dur,
    greatest(CASE WHEN v1 THEN g1 END, CASE WHEN v2 THEN g2 END) AS g FROM a),
org AS (SELECT min(d) AS d0 FROM m WHERE has)
"""


@query(
    "q_import_nested_attempts",
    ATTEMPTS
    + """SELECT CAST(k AS VARCHAR) AS job_id, (epoch_us(d) - epoch_us(d0)) / 1e6 AS submit_time_seconds, dur AS duration_seconds, g::DOUBLE AS gpu_count,
  'HP' AS service_class, 'philly-gpu' AS gpu_model FROM m, org WHERE has AND dur > 0 AND g > 0""",
)
def import_nested_attempts(spark, sf_dir):
    return importers.attempt_jobs(attempt_log(spark, sf_dir), "HP")[0]


@query(
    "q_import_nested_skips",
    ATTEMPTS
    + "SELECT CAST(count(*) FILTER (NOT coalesce(has AND dur > 0 AND g > 0, false)) AS BIGINT) AS skipped_job_count FROM m",
)
def import_nested_skips(spark, sf_dir):
    return importers.attempt_jobs(attempt_log(spark, sf_dir), "HP")[1]


NESTED_JOBS = """SELECT CAST(k AS VARCHAR) AS job_id, (epoch_us(d) - epoch_us(d0)) / 1e6 AS submit_time_seconds, dur AS duration_seconds, g::DOUBLE AS gpu_count,
  'Spot' AS service_class, 'philly-gpu' AS gpu_model FROM m, org WHERE has AND dur > 0 AND g > 0"""
ARRAY_RANGE_BYTES = 1 << 20


@query("q_import_json_array", ATTEMPTS + NESTED_JOBS)
def import_json_array(spark, sf_dir):
    """The attempt log of all orders, laid out as array files and read back by byte ranges."""
    path = shared_path(spark, "arrays")
    write_json_arrays(attempt_log(spark, sf_dir), path)
    log = read_json_array(spark, path, importers.ATTEMPT_LOG, ARRAY_RANGE_BYTES)
    return importers.attempt_jobs(log, "Spot")[0]
