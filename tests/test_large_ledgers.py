"""Steps whose cost grew faster than their input: quantile brackets, ledger jobs, holds by rows, exact sums."""

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from poolwise.functions import exact_quantiles, quantiles
from poolwise.operators import decision_log, fingerprints, metrics
from poolwise.sources import ledger


def test_overfull_brackets_are_cut_again_without_sketches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    # Values that lie within one bucket of the histogram, one value that holds a third, and values beyond all numbers.
    near = 1e9 + rng.uniform(0, 1, 3000)
    near[:1000] = 1e9 + 0.25
    ends = np.array([-np.inf] * 40 + [-3.0, -0.0, 0.0, 2.0] + [np.inf] * 40)
    rows = [("near", float(v)) for v in near] + [("ends", float(v)) for v in ends] + [("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)

    def refuse(*args):
        raise AssertionError("no sketch")

    monkeypatch.setattr(quantiles.F, "percentile_approx", refuse)
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 20)
    probabilities = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probabilities, discrete=True).collect()}
    assert set(got) == {"near", "ends"}
    for group, values in (("near", near), ("ends", ends)):
        ordered = np.sort(values)
        for name, p in probabilities.items():
            assert got[group][name] == ordered[int(np.ceil(p * len(ordered))) - 1]


def test_ledger_jobs_equal_their_grouped_runs_where_orders_repeat(spark, tmp_path, monkeypatch):
    day = datetime.datetime(1995, 3, 4)
    lines = [(k, p * 211 + k, 17 * k + p, n, 10.0 + p, 5.0) for k in range(1, 40) for p, n in ((1, 1), (2, 2), (2, 2), (499, 3))]
    lines += [(k, None, 12 * k, 4, None, None) for k in range(1, 20)] + [(k, 998 + k, 10, 5, None, 1.0) for k in range(1, 20)]
    orders = [(k, k, day + datetime.timedelta(days=k), "1-URGENT" if k % 3 == 0 else "5-LOW") for k in range(1, 40)]
    orders += orders[:20] + [(7, 8, day, None), (8, None, day, "2-HIGH")]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    windows = ledger.ledger_windows(spark)
    whole = metrics.job_ledger(ledger.run_ledger(spark, str(tmp_path)), windows)
    # Many more tasks than the session's, as for a table of many lines.
    monkeypatch.setattr(ledger, "LINES_PER_TASK", 5)
    assert ledger._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    jobs = ledger._jobs(ledger._lines(spark, str(tmp_path), counted=True))
    got = ledger.job_ledger(ledger.in_windows(jobs, windows)).select(whole.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    assert whole.agg(F.max("preemption_count")).first()[0] > 1


def test_blocks_of_a_batch_become_python_values_one_at_a_time():
    batch = pa.RecordBatch.from_pylist([{"chain_id": f"c{i}", "rows": [{"a": i}] * 3} for i in range(5)])
    items = decision_log._items(batch)
    assert next(items) == {"chain_id": "c0", "rows": [{"a": 0}] * 3}
    assert [i["chain_id"] for i in items] == ["c1", "c2", "c3", "c4"]


def test_sums_of_wide_parts_are_exact_without_decimals_by_row(spark):
    top = (1 << 60) - 1
    values = [top - i * 7 for i in range(200)] + [0, 1, (1 << 30) - 1, 1 << 30]
    df = spark.createDataFrame([(v,) for v in values], "p long")
    total = df.agg(fingerprints._exact_sum(F.col("p")).alias("s"))
    assert int(total.first().s) == sum(values)
    plan = total._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(cast(p" not in plan
