"""Training lowers the loss, repeats exactly, and its gradient is the loss's gradient."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwise.operators import tenant_model as tm

MODEL = tm.TenantModel(lookback=24, horizon=2, moving_average_window=5, epochs=4, learning_rate=0.01, validation_hours=30)


@pytest.fixture(scope="module")
def rows(spark):
    hours = [
        ("A", f"t{s}", b, 3.0 + s + 2.0 * math.sin(2 * math.pi * b / 24))
        for s in range(2)
        for b in range(140)
    ]
    df = spark.createDataFrame(hours, "gpu_model string, tenant_id string, bucket long, gpus double")
    built = tm.training_rows(df, MODEL).where(F.size("y") == 2)
    return built.withColumns(
        {
            "series_index": F.when(F.col("tenant_id") == "t1", 1).otherwise(0).cast("long"),
            "validation": F.col("bucket") > 110,
        }
    ).cache()


def test_training_lowers_validation_loss_and_repeats(rows):
    weights, log = tm.train(rows, 2, MODEL)
    again, _ = tm.train(rows, 2, MODEL)
    assert log[-1]["validation_nll"] < log[0]["validation_nll"]
    for name, value in weights.items():
        assert np.allclose(value, again[name], atol=1e-9)


def test_gradient_matches_finite_differences(rows):
    weights = tm._initial(MODEL, 2)
    sums = tm._gradient_job(rows, weights, MODEL)
    step = 1e-5
    for name, place in (("mean", (3, 0)), ("scale", (5, 1)), ("mean_bias", (1, 0)), ("scale_bias", (0, 1))):
        nudged = {n: v.copy() for n, v in weights.items()}
        nudged[name][place] += step
        change = (tm._gradient_job(rows, nudged, MODEL)["loss"][0] - sums["loss"][0]) / step
        assert change == pytest.approx(sums[name][place], rel=2e-2, abs=1e-2)


def test_biases_by_series_equal_indexed_biases(rows):
    by_key, log = tm.train(rows, None, MODEL)
    by_index, wanted = tm.train(rows, 2, MODEL)
    assert [x["validation_nll"] for x in log] == pytest.approx([x["validation_nll"] for x in wanted])
    found = {r.tenant_id: r for r in by_key["biases"].collect()}
    for k, tenant in enumerate(("t0", "t1")):
        for name in tm.BIASES:
            assert found[tenant][name] == pytest.approx(by_index[name][k].tolist(), abs=1e-9)
    assert np.allclose(by_key["mean"], by_index["mean"], atol=1e-9)


def test_forecasts_do_not_depend_on_the_hashes_of_series(spark):
    hashed = spark.range(400).select(F.concat(F.lit("t"), "id").alias("t")).withColumn("slot", F.pmod(F.xxhash64(F.lit("A"), "t"), F.lit(4096)))
    slots = {}
    for r in hashed.orderBy("t").collect():
        slots.setdefault(r.slot, []).append(r.t)
    alike = sorted(x for x in slots.values() if len(x) > 1)[0][:2]
    apart = [x[0] for x in sorted(slots.values()) if len(x) == 1][:2]

    def forecast(tenants):
        hours = [("A", t, b, 5.0 + 40.0 * k + math.sin(2 * math.pi * b / 24)) for k, t in enumerate(tenants) for b in range(140)]
        df = spark.createDataFrame(hours, "gpu_model string, tenant_id string, bucket long, gpus double")
        out = tm.forecast_pools(df, 140 * 3600.0, MODEL).orderBy("horizon_step").collect()
        return [x for r in out for x in (r.mu_gpus, r.sigma_gpus, r.guarantee_quantile_gpus)]

    assert forecast(alike) == pytest.approx(forecast(apart), abs=2e-6)
