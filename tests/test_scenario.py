"""Positions in hot groups, and the jobs of a scenario against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from poolwise.functions import ordered_positions
from poolwise.operators.scenario import forecast_jobs, history_jobs, scenario_jobs, shifted_history, visible_completed

SCHEMA = "job_id string, submit_time_seconds double, duration_seconds double, gpu_count double, service_class string, gpu_model string, tenant_id string"


def test_positions_of_a_hot_group_and_of_null_groups(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 97)).alias("g"),
        (F.col("id") % 11).alias("t"),
        F.col("id").cast("string").alias("name"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = ordered_positions(rows, ["g"], ["t", "name"], total="n")
        found = [tuple(r) for r in numbered.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for g, t, name in sorted(((r.g or "", r.t, r.name) for r in rows.collect())):
        groups.setdefault(g, []).append((t, name))
    assert sorted((g or "", t, name, p, n) for g, t, name, p, n in found) == sorted(
        (g, t, name, p, len(members)) for g, members in groups.items() for p, (t, name) in enumerate(members)
    )


def test_positions_of_an_empty_table_and_without_groups(spark):
    assert ordered_positions(spark.range(0), ["id"], ["id"]).count() == 0
    assert {r.id: r.position for r in ordered_positions(spark.range(5), [], ["id"]).collect()} == {k: k for k in range(5)}


@pytest.mark.parametrize(("interval", "horizon"), [(10.0, 10.0), (5.0, 10.0), (20.0, 4.0)])
def test_history_of_every_cutoff(spark, interval, horizon):
    jobs = [(f"j{k}", k * 1.25, 1.0 + k % 7, 1.0, "HP" if k % 3 else "Spot", "A", None) for k in range(60)]
    jobs += [("edge", 20.0, 0.0, 1.0, "HP", "A", "t"), ("edge", 20.0, 0.0, 1.0, "Spot", "A", "t")]
    n = 4
    found = shifted_history(spark.createDataFrame(jobs, SCHEMA), interval=interval, horizon=horizon, decisions=F.lit(n)).collect()
    wanted = []
    for k in range(1, n + 1):
        cut = k * interval
        past = [j for j in jobs if cut - horizon < j[1] <= cut + 1e-9 and j[1] + j[2] <= cut + 1e-9]
        past.sort(key=lambda j: (j[1], j[0], j[4]))
        wanted += [(k, p, j[0], j[4], j[1] + horizon) for p, j in enumerate(past)]
    assert sorted((r.decision, r.position, r.job_id, r.service_class, r.submit_time_seconds) for r in found) == sorted(wanted)


def test_second_log_wins_and_later_ends_stay_hidden(spark):
    first = [("a", 0.0, 5.0, 1.0, "HP", "A", "t"), ("b", 0.0, 5.0, 1.0, "HP", "A", "t"), ("c", 8.0, 5.0, 1.0, "HP", "A", "t")]
    second = [("a", 0.0, 3.0, 1.0, "HP", "A", "t"), ("b", 0.0, 50.0, 1.0, "HP", "A", "t")]
    both = visible_completed(spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA), 10.0)
    assert sorted((r.job_id, r.duration_seconds) for r in both.collect()) == [("a", 3.0), ("b", 5.0)]


def test_forecast_replaces_past_hp_and_rows_have_fingerprints(spark):
    jobs = [("h", 7000.0, 5.0, 1.0, "HP", "A", "t"), ("s", 7100.0, 5.0, 1.5, "Spot", "A", None)]
    past = shifted_history(spark.createDataFrame(jobs, SCHEMA), interval=7200.0, horizon=7200.0, decisions=F.lit(1))
    pieces = spark.createDataFrame(
        [("A", 0, 10_800.0, 0, 2.0, "t"), ("A", 3, 14_400.0, 11, 2.0, "t")],
        "gpu_model string, point_index int, target_time_seconds double, piece_index int, gpu_count double, tenant_id string",
    )
    nothing = history_jobs(past).limit(0)
    rows = {r.scenario_job_id: r for r in scenario_jobs(nothing, history_jobs(past), forecast_jobs(pieces, 7200.0, 7200.0)).collect()}
    assert sorted(rows) == ["forecast-hp::000000::0000::A", "forecast-hp::000003::0011::A", "history::000001::s"]
    assert [rows[k].submit_time_seconds for k in sorted(rows)] == [7200.0, 10_800.0, 14_300.0]
    text = "job=18:history::000001::s;submit=11:14300000000;duration=7:5000000;gpus=7:1500000;class=4:Spot;pool=1:A;tenant=-;"
    assert rows["history::000001::s"].job_fingerprint == hashlib.sha256(text.encode()).hexdigest()
    alone = [r.scenario_job_id for r in scenario_jobs(nothing, history_jobs(past), None).collect()]
    assert sorted(alone) == ["history::000000::h", "history::000001::s"]
