"""Exact quantiles, ranks and as-of lookups against numpy, hot groups included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolwise.functions import asof_lookup, broadcast_if_small, exact_quantiles, global_value_ranks

PROBS = {"p00": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.fixture(scope="module")
def skewed(spark):
    """One group owns most rows and one value owns a third of them."""
    rng = np.random.default_rng(7)
    hot = rng.exponential(50, 60_000)
    hot[:20_000] = 12.5
    pdf = pd.concat(
        [
            pd.DataFrame({"g": "hot", "v": hot}),
            pd.DataFrame({"g": "small", "v": rng.normal(0, 1, 37)}),
            pd.DataFrame({"g": "one", "v": [4.0]}),
        ]
    )
    return pdf, spark.createDataFrame(pdf).repartition(16).cache()


def test_continuous_quantiles(skewed):
    pdf, df = skewed
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", PROBS, accuracy=1000).collect()}
    for group, part in pdf.groupby("g"):
        for name, p in PROBS.items():
            assert got[group][name] == pytest.approx(np.quantile(part.v, p), abs=1e-9)


def test_nearest_rank_quantiles(skewed):
    pdf, df = skewed
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"p90": 0.9}, discrete=True, accuracy=1000).collect()}
    for group, part in pdf.groupby("g"):
        ordered = np.sort(part.v)
        assert got[group].p90 == ordered[max(0, int(np.ceil(0.9 * len(ordered))) - 1)]


def test_ranks_count_the_smaller_rows(skewed):
    pdf, df = skewed
    got = global_value_ranks(df, ["g"], "v").toPandas()
    for group, part in pdf.groupby("g"):
        ordered = np.sort(part.v)
        mine = got[got.g == group]
        assert int(mine.value_count.sum()) == len(ordered)
        assert (mine.rows_before == np.searchsorted(ordered, mine.v, "left")).all()


def test_asof_takes_the_last_step(spark):
    rng = np.random.default_rng(3)
    steps = pd.DataFrame({"g": "x", "k": np.sort(rng.choice(10_000, 500, replace=False)).astype(float)})
    steps["p"] = np.arange(500)
    probes = pd.DataFrame({"g": "x", "k": rng.uniform(-50, 10_050, 300), "id": np.arange(300)})
    got = asof_lookup(spark.createDataFrame(steps), spark.createDataFrame(probes), ["g"], "k", "p").toPandas()
    expected = np.searchsorted(steps.k, probes.k, "right") - 1
    got = got.sort_values("id")
    assert len(got) == 300
    for have, want in zip(got.p, expected):
        assert (want == -1 and pd.isna(have)) or have == want


def test_quantile_plan_keeps_no_group_in_one_buffer(skewed):
    _, df = skewed
    plan = exact_quantiles(df, ["g"], "v", {"p50": 0.5})._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "percentile(" not in plan
    assert df.where(F.col("v").isNull()).count() == 0


def test_broadcast_is_bound_by_rows_and_by_bytes(spark):
    def hinted(df, **bounds):
        return "broadcast" in broadcast_if_small(df, **bounds)._jdf.queryExecution().logical().toString().lower()

    wide = spark.range(3).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array("id").alias("a.b"))
    assert hinted(wide) and hinted(wide.limit(0))
    assert not hinted(wide, max_rows=2) and not hinted(wide, max_bytes=2000)
