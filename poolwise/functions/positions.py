"""Positions of rows in ordered groups, however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sizing import broadcast_if_small


def ordered_positions(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position", total: str | None = None
) -> DataFrame:
    """Number the rows of each group from 0 in the given order, and count them as ``total`` if that is named.

    Rows are ranged by group and order, so a group that holds most rows spans many tasks; each task numbers its
    own rows, shifted by the rows of the ranges before it. The ranges are written once, as a lost executor must
    not draw their bounds anew. ``order`` has to tell the rows of a group apart, or equal rows are numbered in any
    order. Null groups are groups like others.
    """
    ranged = cut_lineage(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    of_group = Window.partitionBy(*group)
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    shifts = counts.select(
        F.struct(*group, "_range").alias("_place"),
        (F.sum("_rows").over(of_group.orderBy("_range")) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(of_group).alias("_total"),
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    numbered = ranged.withColumns({"_here": F.row_number().over(inside) - 1, "_place": F.struct(*group, "_range")})
    shifted = numbered.join(broadcast_if_small(shifts.withColumnRenamed("_place", "_of")), F.col("_place").eqNullSafe(F.col("_of")))
    extra = [F.col("_total").alias(total)] if total else []
    return shifted.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_here") + F.col("_before")).cast("long").alias(name), *extra)
