"""Queries without a cutoff follow a trace that is longer than a month."""

import os

import pytest
from check_queries import TABLES, compare, oracle_connection
from pyspark.sql import functions as F

from poolwise.plans import load_all

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_trace(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("long"))
    for name in TABLES:
        if name != "events":
            os.symlink(f"{SF}/{name}.parquet", f"{root}/{name}.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    later = events.withColumns({"event_id": F.col("event_id") + 1_000_000, "ts": F.col("ts") + F.expr("INTERVAL 11 DAYS")})
    events.unionByName(later).coalesce(1).write.parquet(f"{root}/events.parquet.d")
    part = next(f for f in os.listdir(f"{root}/events.parquet.d") if f.endswith(".parquet"))
    os.rename(f"{root}/events.parquet.d/{part}", f"{root}/events.parquet")
    return root


@pytest.mark.parametrize("name", ["q_hourly_max", "q_tenant_hourly", "q_forecast_eval", "q_admission_diag", "q_update_forecasts"])
def test_rows_after_day_30_count(spark, long_trace, name):
    query = load_all()[name]
    ok, _, note = compare(spark, oracle_connection(long_trace), long_trace, query.build, query.oracle)
    assert ok, note
    if name == "q_hourly_max":
        assert query.build(spark, long_trace).agg(F.max("bucket")).first()[0] > 30 * 24
