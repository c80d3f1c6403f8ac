"""The every-update forecast agrees with the single-cutoff one, which DuckDB checks."""

import os

import pytest
from pyspark.sql import functions as F

from poolwise.plans import load_all

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


def test_every_update_contains_the_cutoff_forecast(spark):
    queries = load_all()
    single = {tuple(r) for r in queries["q_seasonal_forecast"].build(spark, SF_DIR).collect()}
    updates = queries["q_update_forecasts"].build(spark, SF_DIR).where(F.col("cutoff") == 15.0 * 86400)
    assert {tuple(r)[1:] for r in updates.collect()} == single
