"""Registered queries over the trace: validation, slicing, profile, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import DAY, HOUR
from ..functions import exact_quantiles, rounded
from ..operators import calendar, profile, slicing
from ..sources.tables import TRACE_CTES, TRACE_ORIGIN, table, trace_from_tables
from .registry import query

WITH = "WITH " + TRACE_CTES
SPAN = ", span AS (SELECT min(submit_time_seconds) AS s, max(submit_time_seconds) AS e FROM jobs)"
GRID = (
    SPAN
    + """, ticks AS (SELECT s + i * 3600.0::DOUBLE AS t, i AS tick
  FROM span, range(0, CAST(floor((e - s) / 3600.0::DOUBLE) AS BIGINT) + 1) r(i)),
classes AS (SELECT unnest(['HP', 'Spot']) AS service_class),
active AS (SELECT c.service_class, k.tick, k.t AS sample_time_seconds,
    coalesce(sum(j.gpu_count), 0.0::DOUBLE) AS active_gpus, CAST(count(j.job_id) AS BIGINT) AS active_jobs
  FROM ticks k CROSS JOIN classes c LEFT JOIN jobs j ON j.service_class = c.service_class
    AND j.submit_time_seconds <= k.t AND k.t < j.submit_time_seconds + j.duration_seconds
  GROUP BY 1, 2, 3),
arrivals AS (SELECT c.service_class, k.tick, coalesce(sum(j.gpu_count), 0.0::DOUBLE) AS arrival_requested_gpus
  FROM ticks k CROSS JOIN classes c LEFT JOIN (SELECT service_class, gpu_count,
      least(CAST(floor((submit_time_seconds - s) / 3600.0::DOUBLE) AS BIGINT),
            CAST(floor((e - s) / 3600.0::DOUBLE) AS BIGINT)) AS tick FROM jobs, span) j
    ON j.service_class = c.service_class AND j.tick = k.tick
  GROUP BY 1, 2)
"""
)

# Parameters of the registered slices.
PREFIX_SECONDS = 10 * DAY
WARMUP, EVAL_START, EVAL_END = 9.0 * DAY, 10.0 * DAY, 11.0 * DAY - 1
CUTOFF = 15.0 * DAY
MIN_JOBS = 5


@query(
    "q_trace_validate",
    WITH
    + """, j AS (SELECT jobs.*, coalesce(cap.capacity_gpus, 0.0::DOUBLE) AS eligible FROM jobs LEFT JOIN cap USING (gpu_model))
SELECT 'job_id_empty' AS rule, CAST(count(*) FILTER (trim(job_id) = '') AS BIGINT) AS violation_count FROM j
UNION ALL SELECT 'service_class_unsupported', count(*) FILTER (service_class NOT IN ('HP', 'Spot')) FROM j
UNION ALL SELECT 'job_gpu_model_empty', count(*) FILTER (trim(gpu_model) = '') FROM j
UNION ALL SELECT 'submit_time_negative', count(*) FILTER (submit_time_seconds < 0) FROM j
UNION ALL SELECT 'duration_not_positive', count(*) FILTER (duration_seconds <= 0) FROM j
UNION ALL SELECT 'gpu_count_not_positive', count(*) FILTER (gpu_count <= 0) FROM j
UNION ALL SELECT 'request_exceeds_eligible_capacity', count(*) FILTER (gpu_count > eligible) FROM j
UNION ALL SELECT 'tenant_id_empty', count(*) FILTER (trim(tenant_id) = '') FROM j
UNION ALL SELECT 'node_id_empty', count(*) FILTER (trim(node_id) = '') FROM nodes
UNION ALL SELECT 'node_gpu_model_empty', count(*) FILTER (trim(gpu_model) = '') FROM nodes
UNION ALL SELECT 'node_gpu_count_not_positive', count(*) FILTER (gpu_count <= 0) FROM nodes
UNION ALL SELECT 'job_id_repeated', count(*) FROM (SELECT job_id FROM jobs GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'node_id_repeated', count(*) FROM (SELECT node_id FROM nodes GROUP BY 1 HAVING count(*) > 1)""",
)
def trace_validate(spark, sf_dir):
    return slicing.validate_trace(trace_from_tables(spark, sf_dir))


@query(
    "q_capacity_feasibility",
    WITH
    + """SELECT gpu_model, CAST(count(*) AS BIGINT) AS job_count,
  CAST(count(*) FILTER (gpu_count > capacity_gpus) AS BIGINT) AS infeasible_job_count,
  max(gpu_count) AS largest_request_gpus, max(capacity_gpus) AS eligible_capacity_gpus
FROM jobs JOIN cap USING (gpu_model) GROUP BY 1""",
)
def capacity_feasibility(spark, sf_dir):
    return slicing.capacity_feasibility(trace_from_tables(spark, sf_dir))


@query(
    "q_pool_capacity",
    WITH
    + "SELECT gpu_model, CAST(count(*) AS BIGINT) AS node_count, CAST(sum(gpu_count) AS DOUBLE) AS capacity_gpus FROM nodes GROUP BY 1",
)
def pool_capacity(spark, sf_dir):
    return slicing.pool_capacity(trace_from_tables(spark, sf_dir).nodes)


@query(
    "q_slice_prefix",
    WITH
    + f""", kept AS (SELECT * FROM jobs WHERE submit_time_seconds <= {PREFIX_SECONDS} AND gpu_model IN ('A', '*'))
SELECT k.gpu_model, k.service_class, CAST(count(*) AS BIGINT) AS job_count, round(sum(k.gpu_count), 6) AS requested_gpus,
  round(max(k.submit_time_seconds), 6) AS last_submit_seconds,
  (SELECT CAST(count(*) AS BIGINT) FROM nodes n WHERE n.gpu_model IN (SELECT gpu_model FROM kept)) AS kept_node_count
FROM kept k GROUP BY 1, 2""",
)
def slice_prefix(spark, sf_dir):
    part = slicing.slice_prefix(trace_from_tables(spark, sf_dir, last=PREFIX_SECONDS), PREFIX_SECONDS, {"A"})
    kept_nodes = part.nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return part.jobs.groupBy("gpu_model", "service_class").agg(
        F.count(F.lit(1)).alias("job_count"),
        rounded(F.sum("gpu_count")).alias("requested_gpus"),
        rounded(F.max("submit_time_seconds")).alias("last_submit_seconds"),
    ).withColumn("kept_node_count", kept_nodes)


@query(
    "q_slice_window",
    WITH
    + f"""SELECT job_id, submit_time_seconds, duration_seconds, gpu_count, service_class, gpu_model, tenant_id
FROM jobs WHERE submit_time_seconds >= {WARMUP} AND submit_time_seconds <= {EVAL_END}""",
)
def slice_window(spark, sf_dir):
    return slicing.slice_window(
        trace_from_tables(spark, sf_dir, WARMUP, EVAL_END), WARMUP, EVAL_START, EVAL_END
    ).jobs


@query(
    "q_population_flag",
    WITH
    + f"""SELECT submit_time_seconds >= {EVAL_START} AND submit_time_seconds <= {EVAL_END} AS evaluation_population,
  service_class, CAST(count(*) AS BIGINT) AS job_count, round(sum(gpu_count), 6) AS requested_gpus FROM jobs GROUP BY 1, 2""",
)
def population_flag(spark, sf_dir):
    jobs = trace_from_tables(spark, sf_dir).jobs
    return (
        jobs.withColumn("evaluation_population", slicing.in_population(EVAL_START, EVAL_END))
        .groupBy("evaluation_population", "service_class")
        .agg(
            F.count(F.lit(1)).alias("job_count"),
            rounded(F.sum("gpu_count")).alias("requested_gpus"),
        )
    )


@query(
    "q_cutoff_visible",
    WITH
    + f"""SELECT service_class, gpu_model, CAST(count(*) AS BIGINT) AS visible_jobs,
  CAST(count(*) FILTER (submit_time_seconds + duration_seconds <= {CUTOFF} + 1e-9) AS BIGINT) AS completed_jobs,
  round(max(submit_time_seconds), 6) AS last_visible_submit_seconds
FROM jobs WHERE submit_time_seconds <= {CUTOFF} + 1e-9 GROUP BY 1, 2""",
)
def cutoff_visible(spark, sf_dir):
    visible = slicing.as_of(trace_from_tables(spark, sf_dir, last=CUTOFF).jobs, CUTOFF)
    return visible.groupBy("service_class", "gpu_model").agg(
        F.count(F.lit(1)).alias("visible_jobs"),
        F.count_if("completed_by_cutoff").alias("completed_jobs"),
        rounded(F.max("submit_time_seconds")).alias("last_visible_submit_seconds"),
    )


@query(
    "q_active_samples",
    WITH
    + GRID
    + "SELECT service_class, CAST(tick AS BIGINT) AS tick, round(sample_time_seconds, 6) AS sample_time_seconds, round(active_gpus, 6) AS active_gpus, active_jobs FROM active",
)
def active_samples(spark, sf_dir):
    jobs = trace_from_tables(spark, sf_dir).jobs
    start, end = profile.first_and_last_submit(jobs)
    sampled = profile.active_by_class(jobs, start, end, HOUR)
    return sampled.select(
        "service_class",
        "tick",
        rounded(F.col("sample_time_seconds")).alias("sample_time_seconds"),
        rounded(F.col("active_gpus")).alias("active_gpus"),
        "active_jobs",
    )


@query(
    "q_workload_population",
    WITH
    + """SELECT c.service_class, CAST(count(j.job_id) AS BIGINT) AS job_count,
  round(coalesce(sum(j.gpu_count), 0.0), 6) AS requested_gpus,
  round(coalesce(sum(j.gpu_count * j.duration_seconds / 3600.0::DOUBLE), 0.0), 6) AS requested_gpu_hours
FROM (SELECT unnest(['HP', 'Spot']) AS service_class) c LEFT JOIN jobs j USING (service_class) GROUP BY 1""",
)
def workload_population(spark, sf_dir):
    return profile.population_by_class(trace_from_tables(spark, sf_dir).jobs)


def _stats_sql(measure: str, source: str, value: str) -> str:
    return f"""SELECT '{measure}' AS measure, service_class, round(avg({value}), 6) AS mean,
  round(quantile_cont({value}, 0.5), 6) AS p50, round(quantile_cont({value}, 0.95), 6) AS p95,
  round(max({value}), 6) AS max, CASE WHEN avg({value}) <> 0 THEN round(stddev_pop({value}) / avg({value}), 6) END AS cv
FROM {source} GROUP BY service_class"""


@query(
    "q_workload_stats",
    WITH
    + GRID
    + _stats_sql("duration_seconds", "jobs", "duration_seconds")
    + " UNION ALL "
    + _stats_sql("arrival_requested_gpus", "arrivals", "arrival_requested_gpus")
    + " UNION ALL "
    + _stats_sql("sampled_active_requested_gpus", "active", "active_gpus"),
)
def workload_stats(spark, sf_dir):
    return profile.workload_stats(trace_from_tables(spark, sf_dir).jobs)


@query(
    "q_quantiles",
    WITH
    + """SELECT gpu_model, service_class, round(quantile_cont(duration_seconds, 0.05), 6) AS p05,
  round(quantile_cont(duration_seconds, 0.5), 6) AS p50, round(quantile_cont(duration_seconds, 0.95), 6) AS p95,
  round(quantile_cont(duration_seconds, 0.999), 6) AS p999 FROM jobs GROUP BY 1, 2""",
)
def quantiles(spark, sf_dir):
    values = exact_quantiles(
        trace_from_tables(spark, sf_dir).jobs,
        ["gpu_model", "service_class"],
        "duration_seconds",
        {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p999": 0.999},
    )
    return values.select(
        "gpu_model",
        "service_class",
        *[rounded(F.col(p)).alias(p) for p in ("p05", "p50", "p95", "p999")],
    )


@query(
    "q_arrival_buckets",
    WITH
    + GRID
    + "SELECT service_class, CAST(tick AS BIGINT) AS tick, round(arrival_requested_gpus, 6) AS arrival_requested_gpus FROM arrivals",
)
def arrival_buckets(spark, sf_dir):
    jobs = trace_from_tables(spark, sf_dir).jobs
    start, end = profile.first_and_last_submit(jobs)
    return profile.arrival_buckets(jobs, start, end, HOUR)


@query(
    "q_regime_signals",
    WITH
    + GRID
    + """, per AS (SELECT tick, sum(CASE service_class WHEN 'HP' THEN active_gpus ELSE 0 END) AS hp,
    sum(CASE service_class WHEN 'Spot' THEN active_gpus ELSE 0 END) AS spot FROM active GROUP BY 1),
req AS (SELECT sum(CASE service_class WHEN 'HP' THEN gpu_count ELSE 0 END) AS hp,
    sum(CASE service_class WHEN 'Spot' THEN gpu_count ELSE 0 END) AS spot FROM jobs)
SELECT round(req.spot / (req.hp + req.spot), 6) AS spot_requested_gpu_share,
  round(max(per.hp) / any_value(capacity_gpus), 6) AS hp_peak_active_pressure,
  round(max(per.spot) / any_value(capacity_gpus), 6) AS spot_peak_active_pressure,
  round(max(per.hp + per.spot) / any_value(capacity_gpus), 6) AS combined_peak_active_pressure,
  CASE WHEN req.hp = req.spot THEN 'balanced' WHEN req.hp > req.spot THEN 'HP' ELSE 'Spot' END AS dominant_arrival_type
FROM per, req, total GROUP BY req.hp, req.spot""",
)
def regime_signals(spark, sf_dir):
    return profile.regime_signals(trace_from_tables(spark, sf_dir))


SWEEP = """, bounds AS (SELECT CAST(floor((max(submit_time_seconds) + 1.0::DOUBLE) / 86400.0::DOUBLE) AS BIGINT) AS n FROM jobs),
sweep AS (SELECT p.gpu_model, i AS tick, i * 3600.0::DOUBLE AS sample_time_seconds,
    coalesce(sum(j.gpu_count), 0.0::DOUBLE) AS active_gpus, CAST(count(j.job_id) AS BIGINT) AS active_jobs
  FROM bounds, range(0, n * 24) r(i) CROSS JOIN (SELECT DISTINCT gpu_model FROM jobs) p LEFT JOIN jobs j
    ON j.gpu_model = p.gpu_model AND ceil(j.submit_time_seconds / 3600.0::DOUBLE) <= i
    AND i < ceil((j.submit_time_seconds + j.duration_seconds) / 3600.0::DOUBLE)
  GROUP BY 1, 2, 3)
"""


@query(
    "q_active_sweep",
    WITH
    + SWEEP
    + "SELECT gpu_model, CAST(tick AS BIGINT) AS tick, sample_time_seconds, round(active_gpus, 6) AS active_gpus, active_jobs FROM sweep",
)
def active_sweep(spark, sf_dir):
    jobs = trace_from_tables(spark, sf_dir).jobs
    return profile.active_sweep(
        jobs, ["gpu_model"], HOUR, profile.complete_windows(jobs) * 24
    ).withColumn("active_gpus", rounded(F.col("active_gpus")))


WINDOWS = (
    SWEEP
    + f""", pop AS (SELECT CAST(floor(submit_time_seconds / 86400.0::DOUBLE) AS BIGINT) AS w,
    CAST(count(*) FILTER (service_class = 'HP') AS BIGINT) AS hp_job_count,
    CAST(count(*) FILTER (service_class = 'Spot') AS BIGINT) AS spot_job_count,
    coalesce(sum(gpu_count) FILTER (service_class = 'HP'), 0.0::DOUBLE) AS hp_requested_gpus,
    coalesce(sum(gpu_count) FILTER (service_class = 'Spot'), 0.0::DOUBLE) AS spot_requested_gpus
  FROM jobs GROUP BY 1),
pressure AS (SELECT tick // 24 AS w, max(a) AS peak, avg(a) AS mean FROM
    (SELECT tick, sum(active_gpus) AS a FROM sweep GROUP BY 1) GROUP BY 1),
windows AS (SELECT w * 86400.0::DOUBLE AS start_seconds, w * 86400.0::DOUBLE + 86399 AS end_seconds,
    hp_job_count, spot_job_count, hp_requested_gpus, spot_requested_gpus,
    round(spot_requested_gpus / (hp_requested_gpus + spot_requested_gpus), 6) AS spot_requested_gpu_share,
    round(peak / capacity_gpus, 6) AS combined_peak_active_pressure,
    round(mean / capacity_gpus, 6) AS combined_mean_active_pressure
  FROM pop JOIN pressure USING (w), bounds, total
  WHERE w < n AND hp_job_count >= {MIN_JOBS} AND spot_job_count >= {MIN_JOBS})
"""
)
STRATA = (
    WINDOWS
    + """, s1 AS (SELECT *, ntile(3) OVER (ORDER BY combined_peak_active_pressure, start_seconds) AS pressure_stratum FROM windows),
strata AS (SELECT *, ntile(4) OVER (PARTITION BY pressure_stratum ORDER BY spot_requested_gpu_share, start_seconds)
    AS spot_share_stratum FROM s1)
"""
)


def scanned_windows(spark, sf_dir):
    return profile.daily_windows(
        trace_from_tables(spark, sf_dir), min_hp_jobs=MIN_JOBS, min_spot_jobs=MIN_JOBS
    )


@query("q_daily_windows", WITH + WINDOWS + "SELECT * FROM windows")
def daily_windows(spark, sf_dir):
    return scanned_windows(spark, sf_dir)


@query(
    "q_strata",
    WITH
    + STRATA
    + "SELECT start_seconds, CAST(pressure_stratum AS INT) AS pressure_stratum, CAST(spot_share_stratum AS INT) AS spot_share_stratum FROM strata",
)
def strata(spark, sf_dir):
    return profile.window_strata(scanned_windows(spark, sf_dir)).select(
        "start_seconds", "pressure_stratum", "spot_share_stratum"
    )


@query(
    "q_stratified_medoid",
    WITH
    + STRATA
    + """, c AS (SELECT pressure_stratum AS p, spot_share_stratum AS s, median(combined_peak_active_pressure) AS mp,
    median(spot_requested_gpu_share) AS ms, max(combined_peak_active_pressure) - min(combined_peak_active_pressure) AS sp,
    max(spot_requested_gpu_share) - min(spot_requested_gpu_share) AS ss, count(*) AS cell_size FROM strata GROUP BY 1, 2),
d AS (SELECT strata.*, cell_size, round(CASE WHEN sp <> 0 THEN abs(combined_peak_active_pressure - mp) / sp ELSE 0 END
    + CASE WHEN ss <> 0 THEN abs(spot_requested_gpu_share - ms) / ss ELSE 0 END, 9) AS distance
  FROM strata JOIN c ON p = pressure_stratum AND s = spot_share_stratum)
SELECT CAST(pressure_stratum AS INT) AS pressure_stratum, CAST(spot_share_stratum AS INT) AS spot_share_stratum,
  CAST(cell_size AS BIGINT) AS cell_size, start_seconds, end_seconds, combined_peak_active_pressure, spot_requested_gpu_share,
  round(distance, 6) AS distance
FROM d QUALIFY row_number() OVER (PARTITION BY pressure_stratum, spot_share_stratum ORDER BY distance, start_seconds) = 1""",
)
def stratified_medoid(spark, sf_dir):
    return profile.stratified_medoids(scanned_windows(spark, sf_dir)).select(
        "pressure_stratum",
        "spot_share_stratum",
        "cell_size",
        "start_seconds",
        "end_seconds",
        "combined_peak_active_pressure",
        "spot_requested_gpu_share",
        rounded(F.col("distance")).alias("distance"),
    )


SPLIT = (
    WINDOWS
    + """, split AS (SELECT *, CAST(DATE '2024-01-01' + CAST(start_seconds / 86400 AS INT) AS VARCHAR) AS date,
  CASE WHEN row_number() OVER (ORDER BY start_seconds) <= floor(count(*) OVER () * 0.6)
    THEN 'calibration' ELSE 'evaluation' END AS partition FROM windows)
"""
)


def split_windows(spark, sf_dir):
    return profile.chronological_split(scanned_windows(spark, sf_dir), 0.6)


@query(
    "q_chrono_split",
    WITH + SPLIT + "SELECT date, partition, start_seconds, combined_peak_active_pressure FROM split",
)
def chrono_split(spark, sf_dir):
    return split_windows(spark, sf_dir).select(
        "date", "partition", "start_seconds", "combined_peak_active_pressure"
    )


@query(
    "q_last_wins_union",
    WITH
    + f""", done AS (SELECT * FROM jobs WHERE submit_time_seconds + duration_seconds <= {CUTOFF} + 1e-9),
again AS (SELECT * REPLACE (duration_seconds * 0.5::DOUBLE AS duration_seconds) FROM done WHERE gpu_count >= 2)
SELECT service_class, gpu_model, CAST(count(*) AS BIGINT) AS job_count, round(sum(duration_seconds), 2) AS duration_seconds FROM (
  SELECT * FROM again UNION ALL SELECT * FROM done WHERE (job_id, service_class) NOT IN (SELECT (job_id, service_class) FROM again)) GROUP BY 1, 2""",
)
def last_wins_union(spark, sf_dir):
    """Finished jobs of a trace and of a second one that restates its larger jobs; the second wins."""
    done = slicing.as_of(trace_from_tables(spark, sf_dir, last=CUTOFF).jobs, CUTOFF).where("completed_by_cutoff")
    again = done.where("gpu_count >= 2").withColumn("duration_seconds", F.col("duration_seconds") * 0.5)
    both = slicing.last_wins([done, again], ["job_id", "service_class"])
    return both.groupBy("service_class", "gpu_model").agg(
        F.count(F.lit(1)).alias("job_count"), F.round(F.sum("duration_seconds"), 2).alias("duration_seconds")
    )


def business_calendar(spark, sf_dir):
    """A calendar table with a change for every nation: holidays, make-up days, and back to the weekday."""
    key = F.col("n_nationkey")
    business = F.when(key % 5 == 0, False).when(key % 5 == 3, True)
    return table(spark, sf_dir, "nation").select(F.date_add(F.lit("2024-01-01").cast("date"), key.cast("int")).alias("from_day"), business.alias("business"))


@query(
    "q_calendar_features",
    WITH
    + """, cal AS (SELECT DATE '2024-01-01' + CAST(n_nationkey AS INT) AS from_day, CASE n_nationkey % 5 WHEN 0 THEN false WHEN 3 THEN true END AS business FROM nation),
m AS (SELECT job_id, service_class, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(CAST(round(submit_time_seconds * 1e6) AS BIGINT)) AS moment FROM jobs),
ds AS (SELECT DISTINCT CAST(moment AS DATE) AS day FROM m),
rl AS (SELECT day, CASE WHEN business IS NULL THEN isodow(day) <= 5 ELSE business END AS work FROM ds ASOF LEFT JOIN cal ON ds.day >= cal.from_day)
SELECT job_id, service_class, CAST(work AS INT) AS workday, CAST(isodow(moment) - 1 AS INT) AS weekday, CAST(hour(moment) AS INT) AS hour FROM m JOIN rl ON rl.day = CAST(moment AS DATE)""",
)
def calendar_features(spark, sf_dir):
    jobs = trace_from_tables(spark, sf_dir).jobs.select("job_id", "service_class", "submit_time_seconds")
    return calendar.time_categories(jobs, "submit_time_seconds", TRACE_ORIGIN, business_calendar(spark, sf_dir)).drop("submit_time_seconds")
