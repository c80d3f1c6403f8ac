"""The ledger's report meets jobs that measure alike once, and measures them as if it met each."""

import datetime

import pytest
from pyspark.sql import functions as F

from poolwise.functions import exact_quantiles
from poolwise.operators import metrics
from poolwise.sources import ledger

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
ORDER = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"


def _write(spark, path, lines, orders):
    spark.createDataFrame(lines, LINE).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(orders, ORDER).write.parquet(f"{path}/orders.parquet")
    return str(path)


@pytest.fixture
def odd_tables(spark, tmp_path):
    day = datetime.datetime(1995, 3, 4)
    lines = [(k, p * 211 + k, 17 * k + p, n, 10.0 + p, 5.0) for k in range(1, 80) for p, n in ((1, 1), (2, 2), (2, 2), (499, 3))]
    lines += [(k, None, 12 * k, 4, None, None) for k in range(1, 20)] + [(k, 998 + k, 10, 5, None, 1.0) for k in range(1, 20)]
    lines += [(k, 1499 * k + 1, None, 6, 7.0, 1.0) for k in range(1, 40)] + [(k, -98 - k, -13 * k, 7, 3.5, 1.0) for k in range(1, 40)]
    lines += [(17, 101, 53, 8, 20.0, 1.0), (5020, 499, 13, 1, 1.0, 1.0), (6026, 1, 14, 1, 2.0, 1.0), (None, 1, 1, 1, 1.0, 1.0)]
    orders = [(k, k, day + datetime.timedelta(days=k % 5), "1-URGENT" if k % 3 == 0 else "5-LOW") for k in range(1, 80)]
    orders += orders[:20] + [(7, 8, day, None), (8, None, day, "2-HIGH"), (9, 9, None, "2-HIGH"), (10, 4, datetime.datetime(1994, 1, 2), "5-LOW")]
    orders += [(5020, 1, day, "5-LOW"), (6026, 2, day, "5-LOW"), (None, 1, day, "5-LOW")]
    return _write(spark, tmp_path, lines, orders)


def test_report_equals_that_of_every_run(spark, odd_tables):
    windows, gpus = ledger.ledger_windows(spark), ledger.ledger_capacity(spark, odd_tables)
    jobs = ledger.in_windows(ledger._jobs(ledger._lines(spark, odd_tables)), windows)
    whole = metrics.metrics_report(ledger.run_ledger(spark, odd_tables), windows, F.lit(gpus), jobs=ledger.job_ledger(jobs))
    whole = whole.withColumnRenamed("run_id", "window_id")
    got = ledger.ledger_report(spark, odd_tables)
    assert sorted(map(repr, got.select(whole.columns).collect())) == sorted(map(repr, whole.collect()))
    events, repeated, valid = got.agg(F.sum("preemption_event_count"), F.min("deterministic_repetitions"), F.min("evidence_valid")).first()
    assert events > 0 and repeated is False and valid is False


def test_classes_equal_those_of_jobs_grouped_by_their_runs(spark, odd_tables):
    windows = ledger.ledger_windows(spark)
    whole = metrics.class_metrics(metrics.job_ledger(ledger.run_ledger(spark, odd_tables), windows))
    got = ledger.class_report(spark, odd_tables).select(whole.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))


def test_quantiles_read_shapes_and_not_every_job(spark, tmp_path, monkeypatch):
    day = datetime.datetime(1995, 1, 1)
    # 400 lines of one window, one wait and one length, which no action evicts.
    lines = [(k, 97 * 1499 * k, 7 * k, 1, 10.0, 1.0) for k in range(400)]
    path = _write(spark, tmp_path, lines, [(k, 3, day, "1-URGENT") for k in range(400)])
    read = []

    def counted(df, *args, **options):
        read.append(df.count())
        return exact_quantiles(df, *args, **options)

    monkeypatch.setattr(metrics, "exact_quantiles", counted)
    report = ledger.ledger_report(spark, path).where("action_id = 'native-fifo'").first()
    assert report.hp_preempted_job_rate == 0.0 and report.hp_completion_rate == 1.0
    # One shape, under five actions, by two measures.
    assert report.hp_job_count > 200 and read == [10]


def test_weighted_quantiles_are_those_of_the_repeated_rows(spark, monkeypatch):
    rows = [("a", float(v % 13), 1 + v % 5) for v in range(200)] + [("b", 2.0, 7), ("c", None, 3)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    repeated = df.select("g", "v", F.explode(F.sequence(F.lit(1), "n")))
    shares = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    expected = sorted(map(repr, exact_quantiles(repeated, ["g"], "v", shares).collect()))
    assert sorted(map(repr, exact_quantiles(df, ["g"], "v", shares, weight="n").collect())) == expected
    monkeypatch.setattr("poolwise.functions.quantiles.BRACKET_ROWS", 20)
    assert sorted(map(repr, exact_quantiles(df, ["g"], "v", shares, weight="n").collect())) == expected


def test_jobs_none_of_which_ends_or_is_preempted_have_rates_of_zero(spark):
    rows = [("r", "a", "HP", True, None, 1.0, None, 0, 1, 5), ("r", "a", "Spot", False, 2.0, 1.0, 3.0, 1, 2, 4)]
    schema = "run_id string, action_id string, service_class string, evaluation_population boolean, jct_seconds double, queue_seconds double"
    schema += ", completion_time_seconds double, preemption_count long, run_count long, jobs long"
    got = {r.service_class: r for r in metrics.class_metrics(spark.createDataFrame(rows, schema), stored=True).collect()}
    assert (got["HP"].job_count, got["HP"].completion_rate, got["HP"].preempted_job_rate, got["HP"].run_count) == (5, 0.0, 0.0, 5)
    assert (got["Spot"].job_count, got["Spot"].completion_rate, got["Spot"].preempted_job_rate) == (0, None, None)


def test_layout_needs_no_price_as_lines_that_differ_in_it_alone_are_one_job(spark, odd_tables, tmp_path):
    bare = f"{tmp_path}/bare"
    spark.read.parquet(f"{odd_tables}/lineitem.parquet").drop("l_extendedprice").write.parquet(f"{bare}/lineitem.parquet")
    spark.read.parquet(f"{odd_tables}/orders.parquet").write.parquet(f"{bare}/orders.parquet")
    prices = f"{tmp_path}/prices"
    lines = spark.read.parquet(f"{bare}/lineitem.parquet").withColumn("l_extendedprice", F.rand(3))
    lines.write.parquet(f"{prices}/lineitem.parquet")
    spark.read.parquet(f"{odd_tables}/orders.parquet").write.parquet(f"{prices}/orders.parquet")
    jobs = [sorted(map(repr, ledger._jobs(ledger._lines(spark, path)).collect())) for path in (bare, prices, odd_tables)]
    assert len(jobs[0]) > 300 and jobs[0] == jobs[1] == jobs[2]


def test_fate_behind_its_tests_is_that_of_every_bit(spark):
    rows = [(k, p, s, u) for k in (0, 17, 34, 5020, 5071, 5083, 6026, 6083, 6098, -17, 7) for p in (None, 1, 4, 5, 1500, -1499, -1, 2998) for s in (None, 10, 8, -3) for u in (True, False)]
    df = spark.createDataFrame(rows, "k long, p long, s long, urgent boolean")
    got = df.select("k", "p", "s", "urgent", ledger._fate(F.col("k"), F.col("p"), F.col("s")).alias("fate")).collect()
    mod = lambda a, b: None if a is None else (a % b if a >= 0 else -(-a % b))
    for k, p, s, urgent, fate in got:
        hits = sum(1 << i for i in range(1, 5) if (mod(p, 1499) == i if urgent else s is not None and mod(s + 3 * i, 12 + i) == 0))
        later = {ledger.LONG_ROLLBACK: mod(p, 101) == 0, ledger.LONG_OVERHEAD: mod(s, 53) == 0, ledger.CUT: mod(p, 499) == 0}
        later[ledger.SEEN] = p is not None and mod(p, 211) != 0 and s is not None
        differ = sum(1 << first + i for first, modulus, step in ledger.DIFFERENCES for i in range(5) if mod(k, modulus) == step * i)
        assert fate == differ + (hits + sum(1 << bit for bit, c in later.items() if c) if hits else 0)
