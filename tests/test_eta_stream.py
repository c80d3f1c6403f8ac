"""The stream's eta equals the batch's, over restarts; skipped and repeated updates are errors."""

import random

import pytest
from pyspark.sql import functions as F

from poolwise.operators import forecast
from poolwise.streaming import eta

LAWS = {"tenant": (eta.TenantLaw, forecast.eta_trajectory), "aggregate": (eta.AggregateLaw, forecast.aggregate_eta_trajectory)}
SCHEMA = "gpu_model string, tick long, now_seconds double, eviction_rate double, maximum_spot_wait_seconds double, new_runs boolean, spot_backlog_gpus double"


def updates(n, seed=4):
    rng = random.Random(seed)
    return [
        (pool, i, 300.0 * i, rng.choice([None, 0.0, 0.02, 0.1, 0.3]), rng.choice([0.0, 5000.0]), rng.random() < 0.4, rng.choice([0.0, 3.0, 3.0, 3.0]))
        for pool in "AB"
        for i in range(n)
    ]


class Runs:
    def __init__(self, spark, root, law):
        self.spark, self.root, self.law, self.n = spark, root, law, 0

    def feed(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(f"{self.root}/in")

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.root}/in")
        sink = eta.eta_stream(stream, self.law()).writeStream.format("parquet").outputMode("append")
        query = sink.option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted((r.gpu_model, r.tick, round(r.eta, 9)) for r in self.spark.read.parquet(f"{self.root}/out").collect())


@pytest.mark.parametrize("name", sorted(LAWS))
def test_stream_equals_batch_over_restarts(spark, tmp_path, name):
    law, batch = LAWS[name]
    rows = updates(60)
    runs = Runs(spark, str(tmp_path), law)
    for low, high in ((0, 1), (1, 25), (25, 60)):
        runs.feed([r for r in rows if low <= r[1] < high])
        got = runs.run()
    want = batch(spark.createDataFrame(rows, SCHEMA), ["gpu_model"]).withColumn("eta", F.round("eta", 9))
    assert got == sorted((r.gpu_model, r.tick, r.eta) for r in want.collect())
    assert len({e for _, _, e in got}) > 8


@pytest.mark.parametrize(("tick", "message"), [(4, "monotonic"), (9, "irregular")])
def test_out_of_order_updates_raise(spark, tmp_path, tick, message):
    rows = updates(20)
    runs = Runs(spark, str(tmp_path), eta.TenantLaw)
    runs.feed([r for r in rows if r[1] < 7])
    runs.run()
    runs.feed([r for r in rows if r[1] == tick])
    with pytest.raises(Exception, match=message):
        runs.run()
