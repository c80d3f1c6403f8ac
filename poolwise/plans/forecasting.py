"""Registered queries over demand observation, forecasts and quotas."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..contracts import DAY, HOUR
from ..functions import normal_quantile, rounded
from ..operators import forecast, observation, predictive, tenant_model
from ..operators.forecast import SeasonalConfig
from ..operators.slicing import pool_capacity, total_capacity
from ..session import cut_lineage, shared_path
from ..sources.ledger import FIRST_WINDOW, LEDGER_CTES, WINDOW_COUNT, run_ledger
from ..sources.tables import TRACE_CTES, trace_from_tables
from ..streaming import eta
from .registry import QUERIES, query

WITH = "WITH " + TRACE_CTES
CUTOFF = 15.0 * DAY
STEP = 300.0
Z90 = normal_quantile(0.9)

#: Where a query stops: at its declared cutoff, or at the full hour behind the last arrival.
AT_CUTOFF = f"horizon AS (SELECT {CUTOFF}::DOUBLE AS e, {CUTOFF - 672 * HOUR}::DOUBLE AS earliest)"
AT_END = "horizon AS (SELECT ceil(max(submit_time_seconds) / 3600.0::DOUBLE) * 3600.0::DOUBLE AS e, 0.0::DOUBLE AS earliest FROM jobs)"

OBSERVED = f""", {AT_CUTOFF},
vis AS (SELECT *, submit_time_seconds + duration_seconds AS finish FROM jobs, horizon WHERE submit_time_seconds <= e + 1e-9),
obs_start AS (SELECT e - floor((e - greatest(min(submit_time_seconds), earliest)) / 300.0::DOUBLE + 1e-9) * 300.0::DOUBLE AS s, e FROM jobs, horizon GROUP BY e, earliest),
ticks AS (SELECT i AS tick, s + i * 300.0::DOUBLE AS t, s FROM obs_start, range(0, CAST(floor((e - s) / 300.0::DOUBLE) AS BIGINT) + 1) r(i)),
obs AS (SELECT c.service_class, k.tick, k.t, coalesce(sum(v.gpu_count), 0.0::DOUBLE) AS gpus
  FROM ticks k CROSS JOIN (SELECT unnest(['HP', 'Spot']) AS service_class) c LEFT JOIN vis v
    ON v.service_class = c.service_class AND v.submit_time_seconds <= k.t AND k.t < v.finish GROUP BY 1, 2, 3)
"""
OBSERVED_WHOLE = OBSERVED.replace(AT_CUTOFF, AT_END)


def trace_end(spark, sf_dir) -> float:
    """The full hour behind the last arrival."""
    last = trace_from_tables(spark, sf_dir).jobs.agg(F.max("submit_time_seconds")).first()[0]
    return 0.0 if last is None else math.ceil(last / HOUR) * float(HOUR)


def observed_whole(spark, sf_dir):
    end = trace_end(spark, sf_dir)
    jobs = trace_from_tables(spark, sf_dir).jobs
    return observation.observe_classes(jobs, end, STEP, lookback_hours=math.ceil(end / HOUR))


def observed(spark, sf_dir):
    return observation.observe_classes(trace_from_tables(spark, sf_dir, last=CUTOFF).jobs, CUTOFF, STEP)


@query(
    "q_observation_replay",
    WITH
    + OBSERVED
    + """SELECT CAST(tick AS BIGINT) AS tick, t AS sample_time_seconds, round(max(CASE service_class WHEN 'HP' THEN gpus END), 6) AS hp_outstanding_gpus,
  round(max(CASE service_class WHEN 'Spot' THEN gpus END), 6) AS spot_outstanding_gpus FROM obs GROUP BY 1, 2""",
)
def observation_replay(spark, sf_dir):
    of = lambda c: rounded(F.max(F.when(F.col("service_class") == c, F.col("active_gpus"))))
    return (
        observed(spark, sf_dir)
        .groupBy("tick", "sample_time_seconds")
        .agg(of("HP").alias("hp_outstanding_gpus"), of("Spot").alias("spot_outstanding_gpus"))
    )


@query(
    "q_hourly_max",
    WITH
    + OBSERVED_WHOLE
    + "SELECT service_class, CAST(floor(t / 3600.0::DOUBLE + 1e-9) AS BIGINT) AS bucket, round(max(gpus), 6) AS gpus FROM obs GROUP BY 1, 2",
)
def hourly_max(spark, sf_dir):
    samples = observed_whole(spark, sf_dir)
    return observation.hourly_max(samples, ["service_class"], "active_gpus").withColumn("gpus", rounded(F.col("gpus")))


SEASONAL = f""", trained AS (SELECT s + floor(({CUTOFF} - s) / 86400.0::DOUBLE + 1e-9) * 86400.0::DOUBLE AS fitted_at FROM obs_start),
hist AS (SELECT CAST(floor(t / 3600.0::DOUBLE + 1e-9) AS BIGINT) AS b, max(gpus) AS v FROM obs, trained WHERE service_class = 'HP' AND t <= fitted_at + 1e-9 GROUP BY 1),
fit AS (SELECT *, row_number() OVER (ORDER BY b DESC) AS age FROM hist, trained WHERE b * 3600.0::DOUBLE + 1e-9 >= fitted_at - 672 * 3600 QUALIFY age <= 672),
dayx AS (SELECT b % 24 AS h, avg(v) AS m FROM fit GROUP BY 1), weekx AS (SELECT b % 168 AS h, avg(v) AS m FROM fit GROUP BY 1 HAVING count(*) >= 2),
g AS (SELECT avg(v) AS m FROM fit),
res AS (SELECT fit.*, v - coalesce(weekx.m, dayx.m, g.m) AS r FROM fit CROSS JOIN g LEFT JOIN weekx ON weekx.h = b % 168 LEFT JOIN dayx ON dayx.h = b % 24),
mdl AS (SELECT stddev_pop(r) AS sd, avg(v) FILTER (age <= 24) AS recent, avg(v) FILTER (age BETWEEN 25 AND 48) AS previous FROM res),
cur AS (SELECT b, v, row_number() OVER (ORDER BY b DESC) AS age FROM (SELECT CAST(floor(t / 3600.0::DOUBLE + 1e-9) AS BIGINT) AS b, max(gpus) AS v
    FROM obs WHERE service_class = 'HP' GROUP BY 1) WHERE b * 3600.0::DOUBLE + 1e-9 >= {CUTOFF} - 672 * 3600),
lvl AS (SELECT avg(v - coalesce(weekx.m, dayx.m, g.m)) AS l FROM cur CROSS JOIN g LEFT JOIN weekx ON weekx.h = b % 168 LEFT JOIN dayx ON dayx.h = b % 24 WHERE age <= 24),
fc0 AS (SELECT k AS horizon_step, {CUTOFF} + k * 3600.0::DOUBLE AS target_time_seconds, CAST(floor(({CUTOFF} + k * 3600.0::DOUBLE) / 3600.0::DOUBLE + 1e-9) AS BIGINT) AS b
  FROM range(1, 5) r(k)),
fc1 AS (SELECT horizon_step, target_time_seconds, capacity_gpus, greatest(1.0::DOUBLE, sd) AS sigma,
    greatest(0.0::DOUBLE, least(capacity_gpus, coalesce(weekx.m, dayx.m, g.m) + l + horizon_step * greatest(-greatest(1.0::DOUBLE, capacity_gpus * 0.05::DOUBLE),
      least(greatest(1.0::DOUBLE, capacity_gpus * 0.05::DOUBLE), coalesce((recent - previous) / 24.0::DOUBLE, 0.0::DOUBLE))))) AS mu
  FROM fc0 CROSS JOIN g CROSS JOIN mdl CROSS JOIN lvl CROSS JOIN total LEFT JOIN weekx ON weekx.h = b % 168 LEFT JOIN dayx ON dayx.h = b % 24),
fc AS (SELECT horizon_step, target_time_seconds, capacity_gpus, round(mu, 6) AS mu_gpus, round(sigma, 6) AS sigma_gpus,
    round(greatest(0.0::DOUBLE, least(capacity_gpus, mu + {Z90!r}::DOUBLE * sigma)), 6) AS guarantee_quantile_gpus FROM fc1)
"""


def seasonal_points(spark, sf_dir):
    trace = trace_from_tables(spark, sf_dir)
    hp = observed(spark, sf_dir).where(F.col("service_class") == "HP")
    return forecast.seasonal_forecast(
        hp,
        "active_gpus",
        observation.observation_start(trace.jobs, CUTOFF, STEP, 672),
        CUTOFF,
        total_capacity(trace.nodes),
    )


@query(
    "q_seasonal_forecast",
    WITH
    + OBSERVED
    + SEASONAL
    + "SELECT CAST(horizon_step AS BIGINT) AS horizon_step, target_time_seconds, mu_gpus, sigma_gpus, guarantee_quantile_gpus FROM fc",
)
def seasonal_forecast(spark, sf_dir):
    return seasonal_points(spark, sf_dir)


@query(
    "q_quota_plan",
    WITH
    + OBSERVED
    + SEASONAL
    + """, free AS (SELECT h AS horizon_hours, min(greatest(0.0::DOUBLE, capacity_gpus - guarantee_quantile_gpus)) AS f, any_value(capacity_gpus) AS c
  FROM fc, (SELECT unnest([1, 2, 4]) AS h) WHERE horizon_step <= h GROUP BY 1)
SELECT e.eta, CAST(horizon_hours AS BIGINT) AS horizon_hours, round(f, 6) AS free_gpus,
  CAST(greatest(0, least(c, floor(f * e.eta + 1e-9))) AS BIGINT) AS spot_quota_gpus
FROM free, (SELECT unnest([0.25::DOUBLE, 1.0::DOUBLE, 1.25::DOUBLE]) AS eta) e""",
)
def quota_plan(spark, sf_dir):
    capacity = total_capacity(trace_from_tables(spark, sf_dir).nodes)
    return forecast.quota_plan(seasonal_points(spark, sf_dir), capacity, (0.25, 1.0, 1.25))


TENANTS = f""", {AT_CUTOFF},
vis AS (SELECT *, submit_time_seconds + duration_seconds AS finish FROM jobs, horizon WHERE submit_time_seconds <= e + 1e-9),
grid_start AS (SELECT floor(min(submit_time_seconds) / 300.0::DOUBLE) * 300.0::DOUBLE AS s, e FROM jobs, horizon GROUP BY e),
ticks AS (SELECT i AS tick, s + i * 300.0::DOUBLE AS t FROM grid_start, range(0, CAST(floor((e - s) / 300.0::DOUBLE) AS BIGINT) + 1) r(i)),
pools AS (SELECT c.gpu_model, k.tick, k.t, c.capacity_gpus, coalesce(sum(v.gpu_count) FILTER (v.service_class = 'HP'), 0.0::DOUBLE) AS hp_gpus,
    coalesce(sum(v.gpu_count) FILTER (v.service_class = 'Spot'), 0.0::DOUBLE) AS spot_gpus
  FROM ticks k CROSS JOIN cap c LEFT JOIN vis v ON v.gpu_model = c.gpu_model AND v.submit_time_seconds <= k.t AND k.t < v.finish GROUP BY 1, 2, 3, 4),
series AS (SELECT c.gpu_model, c.tenant_id, k.tick, k.t, coalesce(sum(v.gpu_count), 0.0::DOUBLE) AS gpus
  FROM ticks k CROSS JOIN (SELECT DISTINCT gpu_model, tenant_id FROM vis WHERE service_class = 'HP') c LEFT JOIN vis v ON v.service_class = 'HP'
    AND v.gpu_model = c.gpu_model AND v.tenant_id = c.tenant_id AND v.submit_time_seconds <= k.t AND k.t < v.finish GROUP BY 1, 2, 3, 4),
hourly AS (SELECT gpu_model, tenant_id, CAST(floor(t / 3600.0::DOUBLE + 1e-9) AS BIGINT) AS bucket, max(gpus) AS gpus FROM series GROUP BY 1, 2, 3)
"""


#: Queries without a cutoff of their own run to the end of the trace.
WHOLE = TENANTS.replace(AT_CUTOFF, AT_END)


def tenant_series(spark, sf_dir, cutoff=None):
    cutoff = trace_end(spark, sf_dir) if cutoff is None else cutoff
    jobs = trace_from_tables(spark, sf_dir, last=cutoff).jobs
    return observation.observe_tenants(jobs, cutoff, STEP)


def pool_samples(spark, sf_dir, cutoff=None):
    cutoff = trace_end(spark, sf_dir) if cutoff is None else cutoff
    return observation.observe_pools(trace_from_tables(spark, sf_dir, last=cutoff), cutoff, STEP)


def tenant_hours(spark, sf_dir, cutoff=None):
    return observation.hourly_max(
        tenant_series(spark, sf_dir, cutoff), ["gpu_model", "tenant_id"], "active_gpus"
    )


@query(
    "q_tenant_observation",
    WITH
    + TENANTS
    + """SELECT gpu_model, CAST(tick AS BIGINT) AS tick, t AS sample_time_seconds, capacity_gpus, round(hp_gpus, 6) AS hp_gpus, round(spot_gpus, 6) AS spot_gpus,
  round(greatest(0.0::DOUBLE, capacity_gpus - hp_gpus - spot_gpus), 6) AS idle_gpus FROM pools""",
)
def tenant_observation(spark, sf_dir):
    return pool_samples(spark, sf_dir, CUTOFF)


@query(
    "q_tenant_hourly",
    WITH + WHOLE + "SELECT gpu_model, tenant_id, bucket, round(gpus, 6) AS gpus FROM hourly",
)
def tenant_hourly(spark, sf_dir):
    return tenant_hours(spark, sf_dir)


@query(
    "q_aligned_hourly_max",
    WITH
    + WHOLE
    + """, n AS (SELECT max(tick) + 1 AS n FROM ticks)
SELECT gpu_model, tenant_id, CAST(o AS INT) AS "offset", CAST((tick - o) // 12 AS BIGINT) AS hour_index, round(max(gpus), 6) AS hourly_max_gpus
FROM series, (SELECT unnest(range(0, 12)) AS o), n WHERE tick >= o AND (tick - o) // 12 < (n - o) // 12 GROUP BY 1, 2, 3, 4""",
)
def aligned_hourly_max(spark, sf_dir):
    return observation.aligned_hourly_max(
        tenant_series(spark, sf_dir), ["gpu_model", "tenant_id"], "active_gpus", 12, 1
    )


@query(
    "q_moving_average",
    WITH
    + WHOLE
    + """, p AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY gpu_model, tenant_id) AS n,
    first_value(gpus) OVER (PARTITION BY gpu_model, tenant_id ORDER BY bucket) AS f,
    last_value(gpus) OVER (PARTITION BY gpu_model, tenant_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
  FROM hourly WINDOW w AS (PARTITION BY gpu_model, tenant_id ORDER BY bucket)),
padded AS (SELECT a.gpu_model, a.tenant_id, a.bucket, a.gpus, o,
    CASE WHEN a.i + o < 0 THEN a.f WHEN a.i + o >= a.n THEN a.l ELSE b.gpus END AS x
  FROM p a CROSS JOIN range(-12, 13) r(o) LEFT JOIN p b ON b.gpu_model = a.gpu_model AND b.tenant_id = a.tenant_id AND b.i = a.i + o)
SELECT gpu_model, tenant_id, bucket, round(gpus, 6) AS gpus, round(sum(x) / 25.0::DOUBLE, 6) AS trend, round(any_value(gpus) - sum(x) / 25.0::DOUBLE, 6) + 0.0 AS cycle
FROM padded GROUP BY 1, 2, 3, 4""",
)
def moving_average(spark, sf_dir):
    smooth = observation.moving_average(
        tenant_hours(spark, sf_dir), ["gpu_model", "tenant_id"], "bucket", "gpus", 25
    )
    return smooth.select(
        "gpu_model",
        "tenant_id",
        "bucket",
        "gpus",
        rounded(F.col("trend")).alias("trend"),
        rounded(F.col("cycle")).alias("cycle"),
    )


@query(
    "q_gaussian_pool",
    WITH
    + WHOLE
    + """, c AS (SELECT gpu_model, tenant_id, avg(gpus) AS mu, stddev_pop(gpus) AS sd FROM hourly GROUP BY 1, 2)
SELECT gpu_model, round(sum(mu), 6) AS mu_gpus, round(sqrt(sum(sd * sd)), 6) AS sigma_gpus FROM c GROUP BY 1""",
)
def gaussian_pool(spark, sf_dir):
    components = tenant_hours(spark, sf_dir).groupBy("gpu_model", "tenant_id").agg(
        F.avg("gpus").alias("mu_gpus"), F.stddev_pop("gpus").alias("sigma_gpus")
    )
    return forecast.pool_gaussians(components, ["gpu_model"]).select(
        "gpu_model",
        rounded(F.col("mu_gpus")).alias("mu_gpus"),
        rounded(F.col("sigma_gpus")).alias("sigma_gpus"),
    )


@query(
    "q_quantile_calibration",
    WITH
    + WHOLE
    + """, r AS (SELECT a.gpu_model, round(a.hp_gpus - b.hp_gpus, 6) + 0.0 AS x FROM pools a JOIN pools b ON b.gpu_model = a.gpu_model AND b.tick = a.tick - 288),
o AS (SELECT gpu_model, round(quantile_disc(x, 0.9), 6) + 0.0 AS q FROM r GROUP BY 1)
SELECT gpu_model, q AS quantile_offset_gpus, CAST(count(*) AS BIGINT) AS sample_count, round(count(*) FILTER (x <= 0) / count(*)::DOUBLE, 9) AS raw_coverage,
  round(count(*) FILTER (x <= q + 1e-9) / count(*)::DOUBLE, 9) AS calibrated_coverage,
  CAST(ceil(count(*) * 0.9::DOUBLE) AS BIGINT) AS nearest_rank FROM r JOIN o USING (gpu_model) GROUP BY 1, 2""",
)
def quantile_calibration(spark, sf_dir):
    # The raw forecast here is the pool's demand a day earlier.
    samples = pool_samples(spark, sf_dir).select("gpu_model", "tick", "hp_gpus")
    before = samples.select(
        "gpu_model", (F.col("tick") + 288).alias("tick"), F.col("hp_gpus").alias("forecast")
    )
    residuals = samples.join(before, ["gpu_model", "tick"]).select(
        "gpu_model", rounded(F.col("hp_gpus") - F.col("forecast")).alias("residual_gpus")
    )
    return forecast.residual_calibration(residuals, ["gpu_model"])


PERSISTENCE = f""", sd AS (SELECT gpu_model, stddev_pop(hp_gpus) AS sd FROM pools GROUP BY 1),
targets AS (SELECT p.gpu_model, p.t + k * 3600.0::DOUBLE AS target, p.hp_gpus AS mu, p.hp_gpus + {Z90!r}::DOUBLE * sd AS q
  FROM pools p JOIN sd USING (gpu_model), range(1, 5) r(k) WHERE p.tick % 12 = 0)
"""


@query(
    "q_forecast_eval",
    WITH
    + WHOLE
    + PERSISTENCE
    + """, m AS (SELECT x.gpu_model, p.hp_gpus AS a, mu, q FROM targets x JOIN pools p ON p.gpu_model = x.gpu_model AND CAST(round(p.t * 1e6) AS BIGINT) = CAST(round(target * 1e6) AS BIGINT))
SELECT gpu_model, CAST(count(*) AS BIGINT) AS scored_point_count, round(avg(abs(a - mu)), 6) AS mae_gpus,
  CASE WHEN sum(a) > 0 THEN round(sum(abs(a - mu)) / sum(a), 9) END AS wape, round(avg(a - mu), 6) + 0.0 AS aggregate_mean_error_gpus,
  round(avg(mu - a), 6) + 0.0 AS tenant_mean_error_gpus, round(count(*) FILTER (a <= q + 1e-9) / count(*)::DOUBLE, 9) AS coverage,
  round(avg(greatest(0.9::DOUBLE * (a - q), (0.9::DOUBLE - 1.0::DOUBLE) * (a - q))), 6) AS pinball_loss FROM m GROUP BY 1""",
)
def forecast_eval(spark, sf_dir):
    samples = pool_samples(spark, sf_dir)
    spread = F.stddev_pop("hp_gpus").over(Window.partitionBy("gpu_model"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(4)))
    targets = (
        samples.withColumn("sd", spread)
        .where(F.col("tick") % 12 == 0)
        .select("gpu_model", "sample_time_seconds", "hp_gpus", "sd", steps.alias("k"))
        .select(
            "gpu_model",
            (F.col("sample_time_seconds") + F.col("k") * float(HOUR)).alias("target_time_seconds"),
            F.col("hp_gpus").alias("mu_gpus"),
            (F.col("hp_gpus") + Z90 * F.col("sd")).alias("guarantee_quantile_gpus"),
        )
    )
    actuals = samples.select(
        "gpu_model", "sample_time_seconds", F.col("hp_gpus").alias("actual_gpus")
    )
    return forecast.score_forecasts(targets, actuals, ["gpu_model"])


HOUR_POINTS = f""", h AS (SELECT gpu_model, CAST(floor(t / 3600.0::DOUBLE + 1e-9) AS BIGINT) AS bucket, max(hp_gpus) AS v FROM pools GROUP BY 1, 2),
hp AS (SELECT gpu_model, bucket % 24 AS hod, avg(v) AS mu, stddev_pop(v) AS sd FROM h GROUP BY 1, 2),
pts AS (SELECT gpu_model, k AS horizon_step, round(mu + {Z90!r}::DOUBLE * sd, 6) AS q FROM hp JOIN range(1, 5) r(k) ON hod = CAST(({CUTOFF} + k * 3600) / 3600 AS BIGINT) % 24),
st AS (SELECT gpu_model, capacity_gpus, greatest(0.0::DOUBLE, capacity_gpus - hp_gpus - spot_gpus) AS idle, spot_gpus, CASE gpu_model WHEN 'A' THEN 1.25::DOUBLE ELSE 0.5::DOUBLE END AS eta
  FROM pools WHERE t = {CUTOFF})
"""


@query(
    "q_tenant_quota",
    WITH
    + TENANTS
    + HOUR_POINTS
    + """, f AS (SELECT st.gpu_model, h, min(capacity_gpus - greatest(0, least(capacity_gpus, floor(q + 1e-9)))) FILTER (horizon_step <= h) AS free,
    count(*) FILTER (horizon_step <= h) AS n, any_value(capacity_gpus) AS c, any_value(idle) AS idle, any_value(spot_gpus) AS spot, any_value(eta) AS eta
  FROM st JOIN pts USING (gpu_model), (SELECT unnest([1, 2, 4]) AS h) GROUP BY 1, 2)
SELECT gpu_model, CAST(h AS BIGINT) AS horizon_hours, round(CASE WHEN n >= h THEN free ELSE 0 END, 6) AS free_gpus,
  CAST(CASE WHEN n >= h THEN greatest(0, least(c, floor(least(free * eta, idle + spot) + 1e-9))) ELSE 0 END AS BIGINT) AS spot_quota_gpus FROM f""",
)
def tenant_quota(spark, sf_dir):
    samples = pool_samples(spark, sf_dir, CUTOFF)
    hours = observation.hourly_max(samples, ["gpu_model"], "hp_gpus")
    profile = hours.groupBy("gpu_model", (F.col("bucket") % 24).alias("hour_of_day")).agg(
        F.avg("gpus").alias("mu"), F.stddev_pop("gpus").alias("sd")
    )
    last_hour = int(CUTOFF // HOUR)
    wanted = F.array(
        *[
            F.struct(F.lit((last_hour + k) % 24).alias("h"), F.lit(k).alias("horizon_step"))
            for k in range(1, 5)
        ]
    )
    points = (
        profile.select("*", F.inline(wanted))
        .where(F.col("h") == F.col("hour_of_day"))
        .select(
            "gpu_model",
            "horizon_step",
            rounded(F.col("mu") + Z90 * F.col("sd")).alias("guarantee_quantile_gpus"),
        )
    )
    state = samples.where(F.col("sample_time_seconds") == CUTOFF).select(
        "gpu_model",
        "capacity_gpus",
        "idle_gpus",
        F.col("spot_gpus").alias("running_spot_gpus"),
        F.when(F.col("gpu_model") == "A", 1.25).otherwise(0.5).alias("eta"),
    )
    return forecast.tenant_quota(points, ["gpu_model"], state)


UPDATES = """, waiting AS (SELECT gpu_model, CAST(ceil(submit_time_seconds / 300.0::DOUBLE) AS BIGINT) AS tick, sum(gpu_count) AS backlog, max(duration_seconds) AS wait
  FROM vis WHERE service_class = 'Spot' GROUP BY 1, 2),
upd AS (SELECT p.gpu_model, p.tick, CASE WHEN hp_gpus >= 0.4::DOUBLE * capacity_gpus THEN 0 ELSE 1 END AS quota,
    greatest(0.0::DOUBLE, capacity_gpus - hp_gpus - spot_gpus) AS idle, coalesce(backlog, 0.0::DOUBLE) AS backlog, coalesce(wait, 0.0::DOUBLE) AS wait
  FROM pools p LEFT JOIN waiting w ON w.gpu_model = p.gpu_model AND w.tick * 300.0::DOUBLE = p.t)
"""


def pool_updates(spark, sf_dir):
    """One controller update per pool and sample; a pool two fifths full of HP has no quota.

    The backlog is the Spot demand that arrived since the previous sample and its wait stands in
    as that demand's longest duration.
    """
    jobs = trace_from_tables(spark, sf_dir).jobs
    waiting = (
        jobs.where(F.col("service_class") == "Spot")
        .groupBy(
            "gpu_model", (F.ceil(F.col("submit_time_seconds") / STEP) * STEP).alias("sample_time_seconds")
        )
        .agg(F.sum("gpu_count").alias("backlog"), F.max("duration_seconds").alias("wait"))
    )
    return (
        pool_samples(spark, sf_dir)
        .join(waiting, ["gpu_model", "sample_time_seconds"], "left")
        .select(
            "gpu_model",
            "tick",
            "idle_gpus",
            F.when(F.col("hp_gpus") >= 0.4 * F.col("capacity_gpus"), 0)
            .otherwise(1)
            .alias("spot_quota_gpus"),
            F.coalesce("backlog", F.lit(0.0)).alias("spot_backlog_gpus"),
            F.coalesce("wait", F.lit(0.0)).alias("maximum_spot_wait_seconds"),
        )
    )


@query(
    "q_admission_diag",
    WITH
    + WHOLE
    + UPDATES
    + """SELECT CAST(count(*) AS BIGINT) AS pool_update_count, CAST(count(*) FILTER (quota = 0 AND idle > 1e-9 AND backlog > 1e-9) AS BIGINT) AS zero_quota_with_idle_backlog_count,
  round(count(*) FILTER (quota = 0 AND idle > 1e-9 AND backlog > 1e-9) / count(*)::DOUBLE, 9) AS zero_quota_with_idle_backlog_fraction,
  round(coalesce(sum(idle) FILTER (quota = 0 AND idle > 1e-9 AND backlog > 1e-9), 0.0::DOUBLE) * 300.0::DOUBLE, 6) AS estimated_idle_gpu_seconds,
  round(coalesce(max(wait) FILTER (quota = 0 AND idle > 1e-9 AND backlog > 1e-9), 0.0::DOUBLE), 6) AS maximum_spot_wait_seconds FROM upd""",
)
def admission_diag(spark, sf_dir):
    return forecast.admission_diagnostics(pool_updates(spark, sf_dir), STEP)


FEEDBACK_ACTION = "native-preemptive-3600"
LEDGER_SECONDS = WINDOW_COUNT * DAY
LAST_TICK = int(LEDGER_SECONDS // STEP)
FEEDBACK = f""", sr AS (SELECT gpu_model, node_count::DOUBLE AS w, end_reason = 'preempted' AS evicted, s - queued_since AS waited, gpu_count AS g,
    date_diff('day', DATE '{FIRST_WINDOW}', CAST(run_id AS DATE)) * 86400.0::DOUBLE AS o, s, e FROM runs WHERE service_class = 'Spot' AND action_id = '{FEEDBACK_ACTION}'),
fpools AS (SELECT DISTINCT gpu_model FROM sr),
fticks AS (SELECT i AS tick, i * 300.0::DOUBLE AS t FROM range(0, {LAST_TICK + 1}) r(i)),
fb AS (SELECT p.gpu_model, k.tick, coalesce(sum(w), 0.0::DOUBLE) AS ew, coalesce(sum(w) FILTER (evicted), 0.0::DOUBLE) AS lw,
    count(*) FILTER (o + e > k.t - 300) > 0 AS fresh
  FROM fticks k CROSS JOIN fpools p LEFT JOIN sr ON sr.gpu_model = p.gpu_model AND o + e <= k.t AND o + e >= k.t - 14400 GROUP BY 1, 2),
st AS (SELECT gpu_model, CAST(ceil((o + s) / 300.0::DOUBLE) AS BIGINT) AS tick, max(waited) AS wait, coalesce(sum(g) FILTER (waited > 1800), 0) AS backlog FROM sr GROUP BY 1, 2)
"""


def spot_feedback(spark, sf_dir):
    """Spot runs of one action over all study windows, laid end to end."""
    day = F.datediff(F.col("run_id").cast("date"), F.lit(FIRST_WINDOW).cast("date")) * float(DAY)
    return (
        run_ledger(spark, sf_dir)
        .where((F.col("service_class") == "Spot") & (F.col("action_id") == FEEDBACK_ACTION))
        .select(
            "gpu_model",
            (day + F.col("start_time_seconds")).alias("began"),
            (day + F.col("end_time_seconds")).alias("event_time_seconds"),
            F.col("node_count").cast("double").alias("weight"),
            (F.col("end_reason") == "preempted").alias("evicted"),
            (F.col("start_time_seconds") - F.col("queued_since")).alias("waited"),
            "gpu_count",
        )
    )


def feedback_rates(spark, sf_dir):
    return observation.feedback_window(
        spot_feedback(spark, sf_dir), ["gpu_model"], F.lit(float(LEDGER_SECONDS)), STEP, 14400
    )


def started(spark, sf_dir):
    """Per pool and tick, the longest wait and the GPUs of Spot runs that started since the tick before."""
    return spot_feedback(spark, sf_dir).groupBy("gpu_model", F.ceil(F.col("began") / STEP).alias("tick")).agg(
        F.max("waited").alias("maximum_spot_wait_seconds"),
        F.coalesce(F.sum(F.when(F.col("waited") > 1800, F.col("gpu_count"))), F.lit(0.0)).alias("spot_backlog_gpus"),
    )


@query(
    "q_feedback_rate",
    "WITH "
    + LEDGER_CTES
    + FEEDBACK
    + """SELECT gpu_model, CAST(tick AS BIGINT) AS tick, round(ew, 6) AS event_weight, round(lw, 6) + 0.0 AS evicted_weight,
  CASE WHEN ew > 0 THEN round(lw / ew, 9) + 0.0 END AS eviction_rate FROM fb""",
)
def feedback_rate(spark, sf_dir):
    return feedback_rates(spark, sf_dir).select(
        "gpu_model",
        "tick",
        rounded(F.col("event_weight")).alias("event_weight"),
        rounded(F.col("evicted_weight")).alias("evicted_weight"),
        rounded(F.col("eviction_rate"), 9).alias("eviction_rate"),
    )


@query(
    "q_eta_trajectory",
    "WITH RECURSIVE "
    + LEDGER_CTES
    + FEEDBACK
    + """, law AS MATERIALIZED (SELECT fb.gpu_model, fb.tick, CASE WHEN ew > 0 THEN lw / ew END AS rate, coalesce(wait, 0) AS wait FROM fb LEFT JOIN st USING (gpu_model, tick)),
fold AS (SELECT gpu_model, CAST(-1 AS BIGINT) AS tick, 1.0::DOUBLE AS eta FROM fpools
  UNION ALL SELECT f.gpu_model, l.tick, greatest(0.25::DOUBLE, least(1.25::DOUBLE, CASE WHEN rate >= 1.5::DOUBLE * (1 - 0.9::DOUBLE) THEN eta * ((1 - 0.9::DOUBLE) / rate)
    WHEN rate <= 0.5::DOUBLE * (1 - 0.9::DOUBLE) AND wait > 3600 THEN eta * (1.5::DOUBLE - rate / (1 - 0.9::DOUBLE)) ELSE eta END))
  FROM fold f JOIN law l ON l.gpu_model = f.gpu_model AND l.tick = f.tick + 1)
SELECT gpu_model, tick, round(eta, 7) AS eta FROM fold WHERE tick >= 0""",
)
def eta_trajectory(spark, sf_dir):
    waits = started(spark, sf_dir).drop("spot_backlog_gpus")
    updates = feedback_rates(spark, sf_dir).join(waits, ["gpu_model", "tick"], "left").fillna(0.0, ["maximum_spot_wait_seconds"])
    return forecast.eta_trajectory(updates, ["gpu_model"]).withColumn("eta", rounded(F.col("eta"), 7))


ETA_SQL = QUERIES["q_eta_trajectory"].oracle


@query("q_eta_stream", ETA_SQL)
def eta_stream(spark, sf_dir):
    """The trajectory of q_eta_trajectory from a stream that is stopped half way and started again."""
    waits = started(spark, sf_dir).drop("spot_backlog_gpus")
    updates = cut_lineage(feedback_rates(spark, sf_dir).join(waits, ["gpu_model", "tick"], "left").fillna(0.0, ["maximum_spot_wait_seconds"]))
    root = shared_path(spark, "eta-stream")
    for half in (F.col("tick") <= LAST_TICK // 2, F.col("tick") > LAST_TICK // 2):
        updates.where(half).write.mode("append").parquet(f"{root}/in")
        rows = spark.readStream.schema(updates.schema).parquet(f"{root}/in")
        sink = eta.eta_stream(rows, eta.TenantLaw()).writeStream.format("parquet").outputMode("append")
        run = sink.option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(eta.ETA).parquet(f"{root}/out").withColumn("eta", rounded(F.col("eta"), 7))


@query(
    "q_aggregate_eta",
    "WITH RECURSIVE "
    + LEDGER_CTES
    + FEEDBACK
    + """, law AS MATERIALIZED (SELECT fb.gpu_model, fb.tick, fb.tick * 300.0::DOUBLE AS now, CASE WHEN ew > 0 THEN lw / ew END AS rate, fresh, coalesce(backlog, 0) AS backlog
  FROM fb LEFT JOIN st USING (gpu_model, tick)),
fold AS (SELECT gpu_model, CAST(-1 AS BIGINT) AS tick, 1.0::DOUBLE AS eta, CAST(NULL AS DOUBLE) AS since FROM fpools
  UNION ALL SELECT f.gpu_model, l.tick, greatest(0.25::DOUBLE, least(1.25::DOUBLE, CASE
      WHEN fresh AND rate IS NOT NULL AND rate >= 1.5::DOUBLE * (1 - 0.9::DOUBLE) AND rate > 0 THEN eta * ((1 - 0.9::DOUBLE) / rate)
      WHEN fresh AND rate IS NOT NULL AND rate <= 0.5::DOUBLE * (1 - 0.9::DOUBLE) AND backlog > 0 THEN eta * 1.1::DOUBLE
      WHEN fresh AND rate IS NOT NULL THEN eta
      WHEN backlog > 0 AND now - coalesce(since, now) >= 3600 THEN eta * 1.1::DOUBLE ELSE eta END)),
    CASE WHEN backlog > 0 THEN coalesce(since, now) END
  FROM fold f JOIN law l ON l.gpu_model = f.gpu_model AND l.tick = f.tick + 1)
SELECT gpu_model, tick, round(eta, 7) AS eta FROM fold WHERE tick >= 0""",
)
def aggregate_eta(spark, sf_dir):
    """The aggregate law over the ledger's feedback, one update each five minutes."""
    fresh = spot_feedback(spark, sf_dir).groupBy("gpu_model", F.ceil(F.col("event_time_seconds") / STEP).alias("tick")).agg(
        F.lit(True).alias("new_runs")
    )
    updates = (
        feedback_rates(spark, sf_dir)
        .join(started(spark, sf_dir), ["gpu_model", "tick"], "left")
        .join(fresh, ["gpu_model", "tick"], "left")
        .fillna(0.0, ["spot_backlog_gpus"])
        .fillna(False, ["new_runs"])
        .withColumn("now_seconds", F.col("tick") * STEP)
    )
    return forecast.aggregate_eta_trajectory(updates, ["gpu_model"]).withColumn("eta", rounded(F.col("eta"), 7))


UPDATED = f""", sf AS (SELECT t, CAST(floor(t / 3600.0::DOUBLE + 1e-9) AS BIGINT) AS b, max(gpus) OVER (PARTITION BY CAST(floor(t / 3600.0::DOUBLE + 1e-9) AS BIGINT) ORDER BY t) AS v
  FROM obs WHERE service_class = 'HP'),
fullh AS (SELECT b, max(v) AS v FROM sf GROUP BY 1),
upd AS (SELECT t, b, v, s + floor((t - s) / 86400.0::DOUBLE + 1e-9) * 86400.0::DOUBLE AS f FROM sf, obs_start),
fits AS (SELECT DISTINCT f, CAST(floor(f / 3600.0::DOUBLE + 1e-9) AS BIGINT) AS fb FROM upd),
hist AS (SELECT f, h.b, h.v FROM fits JOIN fullh h ON h.b BETWEEN fb - 671 AND fb - 1 AND h.b >= 0 UNION ALL SELECT f, sf.b, sf.v FROM fits JOIN sf ON sf.t = f),
hx AS (SELECT *, avg(v) OVER (PARTITION BY f) AS overall, avg(v) OVER (PARTITION BY f, b % 24) AS dm,
    CASE WHEN count(*) OVER (PARTITION BY f, b % 168) >= 2 THEN avg(v) OVER (PARTITION BY f, b % 168) END AS wm, row_number() OVER (PARTITION BY f ORDER BY b DESC) AS age FROM hist),
shape AS (SELECT f, stddev_pop(v - coalesce(wm, dm, overall)) AS sd, any_value(overall) AS overall, avg(v) FILTER (age <= 24) AS recent, avg(v) FILTER (age BETWEEN 25 AND 48) AS previous FROM hx GROUP BY 1),
dms AS (SELECT f, b % 24 AS hod, any_value(dm) AS dm FROM hx GROUP BY 1, 2),
wms AS (SELECT f, b % 168 AS how, any_value(wm) AS wm FROM hx GROUP BY 1, 2),
tb AS (SELECT shape.f, r.how, coalesce(wm, dm, overall) AS expected FROM shape CROSS JOIN range(0, 168) r(how) LEFT JOIN dms ON dms.f = shape.f AND hod = how % 24 LEFT JOIN wms ON wms.f = shape.f AND wms.how = r.how),
near AS (SELECT u.t, u.f, h.b, h.v FROM upd u JOIN fullh h ON h.b BETWEEN u.b - 23 AND u.b - 1 AND h.b >= 0 UNION ALL SELECT t, f, b, v FROM upd),
lev AS (SELECT t, near.f, avg(v - expected) AS level FROM near JOIN tb ON tb.f = near.f AND how = b % 168 GROUP BY 1, 2),
up0 AS (SELECT t, k, t + k * 3600.0::DOUBLE AS target, capacity_gpus AS c, greatest({SeasonalConfig().minimum_sigma_gpus}::DOUBLE, sd) AS sg,
    greatest(0.0::DOUBLE, least(capacity_gpus, expected + level + k * greatest(-greatest(1.0::DOUBLE, capacity_gpus * 0.05::DOUBLE),
      least(greatest(1.0::DOUBLE, capacity_gpus * 0.05::DOUBLE), coalesce((recent - previous) / 24.0::DOUBLE, 0.0::DOUBLE))))) AS mu
  FROM lev JOIN shape USING (f) CROSS JOIN range(1, 5) r(k) JOIN tb ON tb.f = lev.f AND how = CAST(floor((t + k * 3600.0::DOUBLE) / 3600.0::DOUBLE + 1e-9) AS BIGINT) % 168, total)
SELECT t AS cutoff, CAST(k AS BIGINT) AS horizon_step, target AS target_time_seconds, round(round(mu, 10), 6) AS mu_gpus, round(round(sg, 10), 6) AS sigma_gpus,
  round(round(greatest(0.0::DOUBLE, least(c, mu + {Z90!r}::DOUBLE * sg)), 10), 6) AS guarantee_quantile_gpus FROM up0"""


@query("q_update_forecasts", WITH + OBSERVED_WHOLE + UPDATED)
def update_forecasts(spark, sf_dir):
    """The seasonal forecast at every five-minute update of the trace."""
    trace, end = trace_from_tables(spark, sf_dir), trace_end(spark, sf_dir)
    start = observation.observation_start(trace.jobs, end, STEP, math.ceil(end / HOUR))
    origin = float(spark.range(1).select(start.alias("s")).first()["s"])
    hp = observed_whole(spark, sf_dir).where(F.col("service_class") == "HP")
    return predictive.update_forecasts(hp, "active_gpus", origin, total_capacity(trace.nodes))


@query("q_tenant_forecast")
def tenant_forecast(spark, sf_dir):
    """Pool forecasts of the trained tenant model; the test span only allows a short lookback."""
    model = tenant_model.TenantModel(lookback=72, validation_hours=72, learning_rate=0.002)
    return tenant_model.forecast_pools(tenant_hours(spark, sf_dir), CUTOFF, model)
