"""The driver tables, and the job/node trace derived from them.

Jobs come from ``events`` and nodes from ``supplier``: every row of both tables is used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import Trace

TRACE_ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _elapsed_seconds(ts: str) -> str:
    return (
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{TRACE_ORIGIN}', CAST({ts} AS TIMESTAMP_NTZ))"
        " / 1000000D"
    )


def jobs_from_events(events: DataFrame) -> DataFrame:
    size = F.get_json_object("props", "$.k").cast("int") % 5
    return events.select(
        F.concat(F.lit("j"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("job_id"),
        F.expr(_elapsed_seconds("ts")).alias("submit_time_seconds"),
        (F.lit(60.0) + F.floor(F.col("value") * 300.0).cast("double")).alias("duration_seconds"),
        F.when(size == 0, 0.5)
        .when(size.isin(1, 2), 1.0)
        .when(size == 3, 2.0)
        .otherwise(4.0)
        .alias("gpu_count"),
        F.when(F.col("event_type").isin("purchase", "signup", "error"), "HP")
        .otherwise("Spot")
        .alias("service_class"),
        F.when(F.col("user_id") % 3 < 2, "A").otherwise("B").alias("gpu_model"),
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
    )


def nodes_from_suppliers(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        F.concat(F.lit("n"), F.lpad(key.cast("string"), 6, "0")).alias("node_id"),
        F.when(key % 3 < 2, "A").otherwise("B").alias("gpu_model"),
        (1 + key % 2).cast("int").alias("gpu_count"),
    )


def arrived_between(events: DataFrame, first: float | None, last: float | None) -> DataFrame:
    """Inclusive bounds on the arrival, as literals on ``ts`` itself, so that the scan can prune by them."""

    def instant(seconds: float, whole) -> str:
        micros = int(whole(seconds * 1_000_000))
        return f"TIMESTAMP_NTZ'{TRACE_ORIGIN}' + make_dt_interval(0, 0, 0, CAST({micros} AS DECIMAL(24, 6)) / 1000000)"

    if first is not None:
        events = events.where(F.expr(f"ts >= {instant(first, math.ceil)}"))
    if last is not None:
        events = events.where(F.expr(f"ts <= {instant(last, math.floor)}"))
    return events


def trace_from_tables(
    spark: SparkSession, sf_dir: str, first: float | None = None, last: float | None = None
) -> Trace:
    """The trace, or its arrivals between ``first`` and ``last`` seconds, both included."""
    return Trace(
        nodes=nodes_from_suppliers(table(spark, sf_dir, "supplier")),
        jobs=jobs_from_events(arrived_between(table(spark, sf_dir, "events"), first, last)),
        trace_id="driver-tables",
        time_origin=TRACE_ORIGIN,
    )


# The same derivation for the DuckDB oracle.
TRACE_CTES = """
jobs AS (
  SELECT 'j' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS job_id,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0::DOUBLE AS submit_time_seconds,
    60.0::DOUBLE + CAST(floor(value * 300.0::DOUBLE) AS DOUBLE) AS duration_seconds,
    CASE CAST(json_extract_string(props, '$.k') AS INT) % 5 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1::DOUBLE
      WHEN 2 THEN 1::DOUBLE WHEN 3 THEN 2::DOUBLE ELSE 4::DOUBLE END AS gpu_count,
    CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'HP' ELSE 'Spot' END AS service_class,
    CASE WHEN user_id % 3 < 2 THEN 'A' ELSE 'B' END AS gpu_model,
    't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id
  FROM events),
nodes AS (
  SELECT 'n' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS node_id,
    CASE WHEN s_suppkey % 3 < 2 THEN 'A' ELSE 'B' END AS gpu_model,
    CAST(1 + s_suppkey % 2 AS INT) AS gpu_count
  FROM supplier),
cap AS (SELECT gpu_model, CAST(sum(gpu_count) AS DOUBLE) AS capacity_gpus FROM nodes GROUP BY 1),
total AS (SELECT sum(capacity_gpus) AS capacity_gpus FROM cap)
"""
