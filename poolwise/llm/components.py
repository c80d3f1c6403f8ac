"""Connected components over an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwise.session import cut_lineage


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (or smaller) neighbours to the smallest node around it."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    around = edges.where(F.col("v") > F.col("u")) if large else edges.where(F.col("v") <= F.col("u"))
    linked = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), any direction, loops ignored. Returns node, component: the smallest node reachable.

    Nodes without an edge do not appear. A round is two shuffles of at most the remaining edges; hubs are
    pre-aggregated, and rounds end when the edge set no longer changes. Null ends are dropped.
    """
    step = cut_lineage(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        # Every edge points from the larger node to the smaller one here.
        grown = _starred(_both_ways(step), large=True)
        pointed = grown.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        step = cut_lineage(_starred(pointed, large=False))
        mark = step.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return step.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        step.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
