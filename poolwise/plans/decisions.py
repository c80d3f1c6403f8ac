"""Registered queries over rolling cutoffs: signals, candidates, survival, scenario pieces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..contracts import DAY, HOUR, ROLLING_ACTIONS
from ..functions import normal_quantile, ordered_positions, rounded
from ..operators import observation, rolling, scenario
from ..operators.profile import complete_windows
from ..operators.slicing import as_of, pool_capacity
from ..session import cut_lineage
from ..sources.tables import TRACE_CTES, trace_from_tables
from .ledgers import canonical_sql
from .registry import query

WITH = "WITH " + TRACE_CTES
CUTOFF = 15.0 * DAY
HORIZON = 4.0 * HOUR
Z90 = normal_quantile(0.9)


def _signals_sql(name: str, history: int, shift: int) -> str:
    h, s = f"{history}.0::DOUBLE", f"{shift}.0::DOUBLE"
    return f"""
{name}w AS (SELECT k AS decision, k * 86400.0::DOUBLE - {s} AS cut, k * 86400.0::DOUBLE - {s} - {h} AS st FROM ks),
{name}j AS (SELECT w.decision, w.st, w.cut, jobs.* FROM {name}w w JOIN jobs ON st < submit_time_seconds AND submit_time_seconds <= cut + 1e-9),
{name}t AS (SELECT decision, count(*) AS n, count(*) FILTER (service_class = 'HP') AS hn, count(*) FILTER (service_class = 'Spot') AS sn,
    coalesce(sum(gpu_count) FILTER (service_class = 'HP'), 0.0::DOUBLE) AS hp, coalesce(sum(gpu_count) FILTER (service_class = 'Spot'), 0.0::DOUBLE) AS spot,
    coalesce(sum(gpu_count) FILTER (service_class = 'HP' AND submit_time_seconds <= st + {h} / 2), 0.0::DOUBLE) AS prior, max(submit_time_seconds) AS mx
  FROM {name}j GROUP BY 1),
{name}a AS (SELECT w.decision, i, coalesce(sum(gpu_count), 0.0::DOUBLE) AS a FROM {name}w w CROSS JOIN range(0, {history // 3600} + 1) r(i) LEFT JOIN {name}j j
    ON j.decision = w.decision AND service_class = 'HP' AND submit_time_seconds <= w.st + i * 3600 AND submit_time_seconds + duration_seconds > w.st + i * 3600 GROUP BY 1, 2),
{name} AS (SELECT w.decision, w.cut AS cutoff_seconds, CAST(coalesce(n, 0) AS BIGINT) AS observed_job_count, CAST(coalesce(hn, 0) AS BIGINT) AS hp_job_count,
    CAST(coalesce(sn, 0) AS BIGINT) AS spot_job_count, round(coalesce(hp, 0), 6) AS hp_requested_gpus, round(coalesce(spot, 0), 6) AS spot_requested_gpus,
    CASE WHEN coalesce(hp + spot, 0) > 0 THEN round(spot / (hp + spot), 9) ELSE 0 END AS spot_requested_gpu_share,
    round(peak, 6) AS hp_peak_active_gpus, round(peak / capacity_gpus, 9) AS hp_peak_active_pressure, round(vol, 6) AS hp_active_volatility_gpus,
    CASE WHEN coalesce(prior, 0) > 0 THEN round((hp - prior) / prior, 9) WHEN coalesce(hp, 0) > 0 THEN 2.0 ELSE 1.0 END AS hp_recent_to_prior_ratio,
    mx AS maximum_observed_submit_time_seconds
  FROM {name}w w LEFT JOIN {name}t USING (decision) JOIN (SELECT decision, max(a) AS peak, stddev_pop(a) AS vol FROM {name}a GROUP BY 1) USING (decision), total)"""


KS = ", nk AS (SELECT CAST(floor((max(submit_time_seconds) + 1.0::DOUBLE) / 86400.0::DOUBLE) AS BIGINT) AS n FROM jobs), ks AS (SELECT k FROM nk, range(1, n + 1) r(k)),"


def _signals(spark, sf_dir, history, shift=0.0):
    trace = trace_from_tables(spark, sf_dir)
    return rolling.window_signals(
        trace,
        interval=float(DAY),
        history=float(history),
        decisions=complete_windows(trace.jobs),
        shift=shift,
    )


@query(
    "q_workload_signals",
    WITH
    + KS
    + _signals_sql("l", DAY, 0)
    + "SELECT * REPLACE (round(maximum_observed_submit_time_seconds, 6) AS maximum_observed_submit_time_seconds) FROM l",
)
def workload_signals(spark, sf_dir):
    return _signals(spark, sf_dir, DAY).withColumn(
        "maximum_observed_submit_time_seconds",
        rounded(F.col("maximum_observed_submit_time_seconds")),
    )


def cutoff_states(spark, sf_dir):
    trace = trace_from_tables(spark, sf_dir)
    long = cut_lineage(_signals(spark, sf_dir, DAY))
    # The forecast summary here is the long window's own peak, its raw quantile five percent lower.
    peaks = long.select(
        "decision",
        F.col("hp_peak_active_gpus").alias("peak_guarantee_gpus"),
        (F.col("hp_peak_active_gpus") * 0.95).alias("peak_raw_guarantee_gpus"),
    )
    return rolling.multi_timescale(
        _signals(spark, sf_dir, HOUR),
        _signals(spark, sf_dir, HOUR, float(HOUR)),
        long,
        rolling.occupancy_snapshot(
            trace, interval=float(DAY), decisions=complete_windows(trace.jobs)
        ),
        peaks,
    )


STATES = (
    _signals_sql("s", HOUR, 0)
    + ","
    + _signals_sql("p", HOUR, HOUR)
    + ","
    + _signals_sql("l", DAY, 0)
    + """, occ AS (SELECT k AS decision, coalesce(sum(gpu_count) FILTER (service_class = 'HP'), 0.0::DOUBLE) AS hp, coalesce(sum(gpu_count) FILTER (service_class = 'Spot'), 0.0::DOUBLE) AS spot
  FROM ks LEFT JOIN jobs ON submit_time_seconds <= k * 86400.0::DOUBLE AND k * 86400.0::DOUBLE < submit_time_seconds + duration_seconds GROUP BY 1),
snap AS (SELECT decision, capacity_gpus AS c, greatest(0.0::DOUBLE, capacity_gpus - hp - spot) AS free, least(spot, capacity_gpus - least(hp, capacity_gpus)) AS rs,
    CASE WHEN hp > capacity_gpus THEN 1 ELSE 0 END AS qh FROM occ, total),
j AS (SELECT l.*, snap.*, greatest(0.0::DOUBLE, c - free - rs) AS rh, l.hp_peak_active_gpus / c AS pc, (l.hp_peak_active_gpus * 0.95::DOUBLE) / c AS pr,
    s.spot_requested_gpu_share AS sshare, CASE WHEN p.hp_requested_gpus > 1e-9 THEN round(s.hp_requested_gpus / p.hp_requested_gpus, 9)
      WHEN s.hp_requested_gpus > 1e-9 THEN 2.0 ELSE 1.0 END AS growth,
    CASE WHEN p.hp_requested_gpus + p.spot_requested_gpus > 1e-9 THEN round((s.hp_requested_gpus + s.spot_requested_gpus) / (p.hp_requested_gpus + p.spot_requested_gpus), 9)
      WHEN s.hp_requested_gpus + s.spot_requested_gpus > 1e-9 THEN 2.0 ELSE 1.0 END AS tgrowth
  FROM l JOIN s USING (decision) JOIN p USING (decision) JOIN snap USING (decision)),
state AS (SELECT decision, cutoff_seconds, growth AS hp_ratio_short_vs_previous, tgrowth AS total_ratio_short_vs_previous,
  round(sshare - spot_requested_gpu_share, 9) + 0.0 AS spot_share_delta_short_vs_long, round(free / c, 9) AS free_gpu_rate, round(rh, 6) AS running_hp_gpus,
  round(rh / c, 9) AS running_hp_pressure, round(rs / c, 9) AS running_spot_pressure, CAST(qh AS BIGINT) AS queued_hp_job_count,
  round(pc, 9) AS peak_calibrated_pressure, round(pr, 9) AS peak_raw_pressure,
  CASE WHEN qh > 0 OR rh / c >= 0.8 OR pc >= 0.9 OR pr >= 1.0 OR growth >= 1.5 THEN 'high'
    WHEN rh / c >= 0.6 OR pc >= 0.75 OR pr >= 0.9 OR growth >= 1.2 THEN 'moderate' ELSE 'low' END AS risk_level,
  CASE WHEN qh > 0 OR rh / c >= 0.8 THEN 'hp-constrained' WHEN pr >= 1.0 OR pc >= 0.9 THEN 'forecast-constrained'
    WHEN sshare >= 0.55 THEN 'spot-heavy' ELSE 'balanced' END AS workload_regime,
  hp_peak_active_pressure, spot_requested_gpu_share, hp_recent_to_prior_ratio FROM j)
"""
)


@query("q_multi_timescale", WITH + KS + STATES + "SELECT * FROM state")
def multi_timescale(spark, sf_dir):
    return cutoff_states(spark, sf_dir)


@query(
    "q_rule_candidates",
    WITH
    + KS
    + STATES
    + """, r AS (SELECT decision, cutoff_seconds, CASE WHEN risk_level = 'high' OR queued_hp_job_count > 0 OR hp_peak_active_pressure >= 0.85 OR hp_recent_to_prior_ratio >= 1.25
    THEN 'high-hp-or-forecast-risk' WHEN spot_requested_gpu_share >= 0.55 THEN 'spot-heavy-history' ELSE 'balanced-or-low-pressure-history' END AS reason_code FROM state)
SELECT *, CASE reason_code WHEN 'high-hp-or-forecast-risk' THEN 'rolling-fifo-open,rolling-preemptive-open-d0000,rolling-preemptive-open-loss-aware'
  WHEN 'spot-heavy-history' THEN 'rolling-fifo-open,rolling-preemptive-open-d0000,native-fifo'
  ELSE 'rolling-fifo-open,native-fifo,rolling-preemptive-open-d0000' END AS candidate_action_ids FROM r""",
)
def rule_candidates(spark, sf_dir):
    return rolling.rule_candidates(cutoff_states(spark, sf_dir), ROLLING_ACTIONS).withColumn(
        "candidate_action_ids", F.array_join("candidate_action_ids", ",")
    )


def carryover_jobs(jobs, cutoff):
    """Jobs that plain occupancy still holds at the cutoff, with their elapsed time."""
    return (
        as_of(jobs, cutoff)
        .where(~F.col("completed_by_cutoff"))
        .select(
            "job_id",
            "service_class",
            "gpu_model",
            "gpu_count",
            "tenant_id",
            (F.lit(cutoff) - F.col("submit_time_seconds")).alias("elapsed_seconds"),
        )
    )


def survival(spark, sf_dir):
    jobs = trace_from_tables(spark, sf_dir).jobs
    completed = as_of(jobs, CUTOFF).where("completed_by_cutoff")
    return rolling.survival_estimates(completed, carryover_jobs(jobs, CUTOFF), HORIZON)


def _survival_sql(cut, done="SELECT * FROM jobs"):
    return f""", done AS (SELECT * FROM ({done}) WHERE submit_time_seconds <= {cut} + 1e-9 AND submit_time_seconds + duration_seconds <= {cut} + 1e-9),
carry AS (SELECT *, {cut} - submit_time_seconds AS elapsed FROM jobs WHERE submit_time_seconds <= {cut} + 1e-9 AND submit_time_seconds + duration_seconds > {cut} + 1e-9),
pools AS (SELECT DISTINCT service_class, gpu_model FROM done),
pairs AS (SELECT c.job_id, d.duration_seconds AS d, c.elapsed FROM carry c LEFT JOIN pools p ON p.service_class = c.service_class AND p.gpu_model = c.gpu_model
  JOIN done d ON d.service_class = c.service_class AND (p.gpu_model IS NULL OR d.gpu_model = c.gpu_model)),
meds AS (SELECT job_id, count(*) AS n, count(*) FILTER (d > elapsed) AS alive, median(d - elapsed) FILTER (d > elapsed) AS sm, median(d) AS am FROM pairs GROUP BY 1),
est AS (SELECT c.job_id, c.service_class, c.gpu_model, c.gpu_count, c.tenant_id, c.elapsed AS elapsed_seconds,
    least({HORIZON}::DOUBLE, greatest(60.0::DOUBLE, CASE WHEN n IS NULL THEN 3600.0 WHEN alive > 0 THEN sm ELSE greatest(3600.0::DOUBLE, am) END)) AS estimated_remaining_seconds,
    CASE WHEN n IS NULL THEN 'sparse-history-one-hour-fallback' WHEN alive > 0 THEN 'conditional-survival-median' ELSE 'right-censored-class-median-fallback' END AS estimator_method,
    CAST(CASE WHEN alive > 0 THEN alive ELSE coalesce(n, 0) END AS BIGINT) AS estimator_sample_count
  FROM carry c LEFT JOIN meds USING (job_id))
"""


SURVIVAL = _survival_sql(CUTOFF)


@query(
    "q_survival_median",
    WITH
    + SURVIVAL
    + "SELECT * REPLACE (round(elapsed_seconds, 6) AS elapsed_seconds, round(estimated_remaining_seconds, 6) AS estimated_remaining_seconds) FROM est",
)
def survival_median(spark, sf_dir):
    return survival(spark, sf_dir).withColumns(
        {
            c: rounded(F.col(c))
            for c in ("elapsed_seconds", "estimated_remaining_seconds")
        }
    )


def forecast_points(trace, cutoff):
    """Hour-of-day quantile of each pool's observed HP demand for the next hours."""
    samples = observation.observe_pools(trace, cutoff, 300.0)
    hours = observation.hourly_max(samples, ["gpu_model"], "hp_gpus")
    profile = hours.groupBy("gpu_model", (F.col("bucket") % 24).alias("hour_of_day")).agg(
        F.avg("gpus").alias("mu"), F.stddev_pop("gpus").alias("sd")
    )
    hour = int(cutoff // HOUR)
    steps = int(HORIZON // HOUR)
    wanted = F.array(
        *[F.struct(F.lit((hour + k) % 24).alias("h"), F.lit(k).alias("k")) for k in range(1, steps + 1)]
    )
    order = Window.orderBy("gpu_model", "k")
    return (
        profile.select("*", F.inline(wanted))
        .where(F.col("h") == F.col("hour_of_day"))
        .select(
            "gpu_model",
            (F.row_number().over(order) - 1).alias("point_index"),
            (F.lit(cutoff) + F.col("k") * float(HOUR)).alias("target_time_seconds"),
            rounded(F.col("mu") + Z90 * F.col("sd")).alias("guarantee_quantile_gpus"),
        )
    )


def scenario_pieces(trace, estimates, cutoff=CUTOFF, workload=None):
    """HP pieces for what the forecast expects beyond carry-over that should still be running.

    Shapes come from the finished HP jobs of ``workload``, or of the trace itself.
    """
    points = cut_lineage(forecast_points(trace, cutoff))
    estimates = cut_lineage(estimates)
    hp = estimates.where(F.col("service_class") == "HP")
    surviving = (
        points.join(hp, "gpu_model")
        .where(
            F.col("estimated_remaining_seconds")
            > F.col("target_time_seconds") - cutoff + 1e-9
        )
        .groupBy("point_index")
        .agg(F.sum("gpu_count").alias("surviving_gpus"))
    )
    capacity = pool_capacity(trace.nodes).select("gpu_model", "capacity_gpus")
    total = F.least(
        F.col("capacity_gpus"), F.greatest(F.lit(0.0), F.col("guarantee_quantile_gpus"))
    )
    asked = (
        points.join(capacity, "gpu_model")
        .join(surviving, "point_index", "left")
        .withColumn(
            "requested_gpus",
            F.greatest(F.lit(0.0), total - F.coalesce("surviving_gpus", F.lit(0.0))),
        )
    )
    finish = F.col("submit_time_seconds") + F.col("duration_seconds")
    history = (trace.jobs if workload is None else workload).where(
        (F.col("service_class") == "HP")
        & (F.col("submit_time_seconds") > cutoff - HORIZON)
        & (F.col("submit_time_seconds") <= cutoff + 1e-9)
        & (finish <= cutoff + 1e-9)
    ).select("gpu_model", "gpu_count", "tenant_id", F.lit(0).alias("src"), F.col("submit_time_seconds").alias("t"), "job_id")
    carried = hp.select(
        "gpu_model", "gpu_count", "tenant_id", F.lit(1).alias("src"), F.lit(0.0).alias("t"), "job_id"
    )
    fitting = history.unionByName(carried).join(capacity, "gpu_model").where("gpu_count <= capacity_gpus").drop("capacity_gpus")
    templates = ordered_positions(fitting, ["gpu_model"], ["src", "t", "job_id"], total="template_count")
    return rolling.forecast_pieces(asked, templates.drop("src", "t", "job_id"))


def _pieces_sql(cut, past="done"):
    return f""", ticks AS (SELECT s + i * 300.0::DOUBLE AS t FROM (SELECT floor(min(submit_time_seconds) / 300.0::DOUBLE) * 300.0::DOUBLE AS s, any_value({cut}) AS c FROM jobs), range(0, CAST(floor((c - s) / 300.0::DOUBLE) AS BIGINT) + 1) r(i)),
hs AS (SELECT cap.gpu_model, k.t, coalesce(sum(gpu_count), 0.0::DOUBLE) AS g FROM ticks k CROSS JOIN cap LEFT JOIN jobs j ON j.gpu_model = cap.gpu_model AND service_class = 'HP'
    AND submit_time_seconds <= k.t AND k.t < submit_time_seconds + duration_seconds GROUP BY 1, 2),
hh AS (SELECT gpu_model, CAST(floor(t / 3600.0::DOUBLE + 1e-9) AS BIGINT) AS b, max(g) AS v FROM hs GROUP BY 1, 2),
pf AS (SELECT gpu_model, b % 24 AS hod, avg(v) AS mu, stddev_pop(v) AS sd FROM hh GROUP BY 1, 2),
pts AS (SELECT gpu_model, row_number() OVER (ORDER BY gpu_model, k) - 1 AS pi, {cut} + k * 3600.0::DOUBLE AS target, round(mu + {Z90!r}::DOUBLE * sd, 6) AS q
  FROM pf JOIN range(1, 5) r(k) ON hod = CAST({cut} / 3600 + k AS BIGINT) % 24),
req AS (SELECT p.*, capacity_gpus, greatest(0.0::DOUBLE, least(capacity_gpus, greatest(0.0::DOUBLE, q)) - coalesce((SELECT sum(e.gpu_count) FROM est e WHERE e.service_class = 'HP'
    AND e.gpu_model = p.gpu_model AND e.estimated_remaining_seconds > p.target - {cut} + 1e-9), 0.0::DOUBLE)) AS r FROM pts p JOIN cap USING (gpu_model)),
tm0 AS (SELECT gpu_model, gpu_count, tenant_id, 0 AS src, submit_time_seconds AS t, job_id FROM {past} WHERE service_class = 'HP' AND submit_time_seconds > {cut} - {HORIZON}
  UNION ALL SELECT gpu_model, gpu_count, tenant_id, 1, 0.0, job_id FROM est WHERE service_class = 'HP'),
tmf AS (SELECT tm0.* FROM tm0 JOIN cap USING (gpu_model) WHERE gpu_count <= capacity_gpus),
tm AS (SELECT gpu_model, gpu_count, tenant_id, row_number() OVER (PARTITION BY gpu_model ORDER BY src, t, job_id) - 1 AS pos, count(*) OVER (PARTITION BY gpu_model) AS n FROM tmf),
tc AS (SELECT gpu_model, count(*) AS n FROM tmf GROUP BY 1),
sl AS (SELECT req.gpu_model, pi, target, r, i, greatest(r / 256, coalesce(tm.gpu_count, least(r, greatest(1.0::DOUBLE, capacity_gpus / 64)))) AS size,
    coalesce(tm.tenant_id, 'forecast-aggregate') AS tenant_id FROM req CROSS JOIN range(0, 256) s(i) LEFT JOIN tc ON tc.gpu_model = req.gpu_model
  LEFT JOIN tm ON tm.gpu_model = req.gpu_model AND tm.pos = (pi + i) % tc.n WHERE r > 1e-9),
cs AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY pi ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before FROM sl),
pieces AS (SELECT gpu_model, CAST(pi AS INT) AS point_index, target AS target_time_seconds, CAST(i AS INT) AS piece_index, round(least(size, r - before), 6) AS gpu_count, tenant_id
FROM cs WHERE r - before > 1e-9)
"""


@query("q_forecast_pieces", WITH + SURVIVAL + _pieces_sql(CUTOFF) + "SELECT * FROM pieces")
def forecast_pieces(spark, sf_dir):
    trace = trace_from_tables(spark, sf_dir)
    return scenario_pieces(trace, survival(spark, sf_dir)).withColumn(
        "gpu_count", rounded(F.col("gpu_count"))
    )


def second_log(jobs):
    """A workload log that lacks a tenant and restates the larger jobs."""
    half = F.when(F.col("gpu_count") >= 2, 0.5).otherwise(1.0)
    return jobs.where("tenant_id <> 't4'").withColumn("duration_seconds", F.col("duration_seconds") * half)


SECOND_LOG = """, wl AS (SELECT * REPLACE (CASE WHEN gpu_count >= 2 THEN duration_seconds * 0.5::DOUBLE ELSE duration_seconds END AS duration_seconds) FROM jobs WHERE tenant_id <> 't4')
"""


def _scenario_sql(source):
    micros = lambda c: f"CAST(round({c} * 1000000) AS BIGINT)"
    values = {
        "job": "scenario_job_id",
        "submit": micros("submit_time_seconds"),
        "duration": micros("duration_seconds"),
        "gpus": micros("gpu_count"),
        "class": "service_class",
        "pool": "gpu_model",
        "tenant": "tenant_id",
    }
    shown = {c: f"round({c}, 6) AS {c}" for c in ("submit_time_seconds", "duration_seconds", "gpu_count")}
    return f"SELECT * REPLACE ({', '.join(shown.values())}), sha256({canonical_sql(values)}) AS job_fingerprint FROM {source}"


def shown_scenario(jobs):
    return jobs.withColumns({c: rounded(F.col(c)) for c in ("submit_time_seconds", "duration_seconds", "gpu_count")})


@query(
    "q_scenario_history",
    WITH
    + KS.rstrip(",")
    + SECOND_LOG
    + """, past AS (SELECT k AS decision, wl.*, row_number() OVER (PARTITION BY k ORDER BY submit_time_seconds, job_id) - 1 AS i FROM ks JOIN wl
  ON submit_time_seconds > (k - 1) * 86400.0::DOUBLE AND submit_time_seconds <= k * 86400.0::DOUBLE + 1e-9 AND submit_time_seconds + duration_seconds <= k * 86400.0::DOUBLE + 1e-9),
moved AS (SELECT decision, 'history::' || lpad(CAST(i AS VARCHAR), CAST(greatest(6, length(CAST(i AS VARCHAR))) AS INT), '0') || '::' || job_id AS scenario_job_id, 'history' AS origin,
  submit_time_seconds + 86400.0::DOUBLE AS submit_time_seconds, duration_seconds, gpu_count, service_class, gpu_model, tenant_id FROM past)
"""
    + _scenario_sql("moved"),
)
def scenario_history(spark, sf_dir):
    """The finished arrivals of each whole day, as the scenario of the next one."""
    jobs = trace_from_tables(spark, sf_dir).jobs
    moved = scenario.shifted_history(
        second_log(jobs), interval=float(DAY), horizon=float(DAY), decisions=complete_windows(jobs)
    )
    named = scenario.history_jobs(moved, "decision")
    return shown_scenario(scenario.with_fingerprints(named))


LAST_CUT = "(SELECT n * 86400.0::DOUBLE FROM nk)"
VISIBLE = f"""SELECT * FROM wl WHERE submit_time_seconds + duration_seconds <= {LAST_CUT} + 1e-9 UNION ALL
  SELECT * FROM jobs WHERE (job_id, service_class) NOT IN (SELECT (job_id, service_class) FROM wl WHERE submit_time_seconds + duration_seconds <= {LAST_CUT} + 1e-9)"""


@query(
    "q_scenario_jobs",
    WITH
    + KS.rstrip(",")
    + SECOND_LOG
    + _survival_sql(LAST_CUT, VISIBLE)
    + f""", wdone AS (SELECT * FROM wl WHERE submit_time_seconds + duration_seconds <= {LAST_CUT} + 1e-9)"""
    + _pieces_sql(LAST_CUT, "wdone")
    + f""", past AS (SELECT *, row_number() OVER (ORDER BY submit_time_seconds, job_id) - 1 AS i FROM wdone WHERE submit_time_seconds > {LAST_CUT} - {HORIZON}),
held AS (SELECT *, row_number() OVER (ORDER BY elapsed_seconds DESC, job_id) - 1 AS i FROM est),
scn AS (SELECT 'carryover::' || lpad(CAST(i AS VARCHAR), 6, '0') || '::' || job_id AS scenario_job_id, 'carryover' AS origin, {LAST_CUT} AS submit_time_seconds,
    estimated_remaining_seconds AS duration_seconds, gpu_count, service_class, gpu_model, tenant_id FROM held
  UNION ALL SELECT 'history::' || lpad(CAST(i AS VARCHAR), 6, '0') || '::' || job_id, 'history', submit_time_seconds + {HORIZON}, duration_seconds, gpu_count, service_class, gpu_model, tenant_id
  FROM past WHERE service_class <> 'HP'
  UNION ALL SELECT 'forecast-hp::' || lpad(CAST(point_index AS VARCHAR), 6, '0') || '::' || lpad(CAST(piece_index AS VARCHAR), 4, '0') || '::' || gpu_model, 'forecast-hp',
    greatest({LAST_CUT}, target_time_seconds - 3600), greatest(60.0::DOUBLE, least(3600.0::DOUBLE, {LAST_CUT} + {HORIZON} - (target_time_seconds - 3600))), gpu_count, 'HP', gpu_model, tenant_id FROM pieces)
"""
    + _scenario_sql("scn"),
)
def scenario_at_last_cutoff(spark, sf_dir):
    """The whole scenario of the last whole day's end: carry-over, past Spot arrivals, HP from the forecast."""
    trace = trace_from_tables(spark, sf_dir)
    days = trace.jobs.agg(complete_windows(trace.jobs).alias("n")).first()["n"]
    cutoff = (days or 0) * float(DAY)
    workload = second_log(trace.jobs)
    completed = scenario.visible_completed(trace.jobs, workload, cutoff)
    estimates = cut_lineage(rolling.survival_estimates(completed, carryover_jobs(trace.jobs, cutoff), HORIZON))
    pieces = scenario_pieces(trace, estimates, cutoff, workload).withColumn("gpu_count", rounded(F.col("gpu_count")))
    recent = workload.where((F.col("submit_time_seconds") > cutoff - HORIZON) & (F.col("submit_time_seconds") <= cutoff + 1e-9))
    past = scenario.shifted_history(recent, interval=max(cutoff, HORIZON), horizon=HORIZON, decisions=F.lit(1))
    return shown_scenario(
        scenario.scenario_jobs(
            scenario.carried_jobs(estimates, cutoff),
            scenario.history_jobs(past),
            scenario.forecast_jobs(pieces, cutoff, HORIZON),
        )
    )
