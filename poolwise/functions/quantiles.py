"""Exact quantiles and ranks without collecting a group into one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, and a sketch per group costs
more than the rows it summarises. Here a histogram of ordered buckets, an ordinary partial aggregate, finds the
bucket that holds each wanted rank, and one further pass counts exact values only inside it. A bucket of very
many rows is first cut again. The answer is exact; the rows that travel are the bracket's, not the group's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sizing import broadcast_if_small

#: Buckets of the histogram for each factor of e in the values.
BUCKETS_PER_E = 64
#: A bracket of more rows that are not all equal is cut again, into so many parts.
BRACKET_ROWS = 1_000_000
BRACKET_PARTS = 4_000
#: Buckets of ordered values: at least so many, and more where they would exceed so many rows each.
RANK_BUCKETS = 64
ROWS_PER_BUCKET = 500_000


def _bucket(v: Column) -> Column:
    """A long that never falls as the value rises; NaN is the greatest value, as in Spark's order."""
    size = F.floor(F.log1p(F.abs(v)) * BUCKETS_PER_E)
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v < 0, -size).otherwise(size)


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    *,
    discrete: bool = False,
    bounded_groups: bool = False,
    accuracy: int = BRACKET_PARTS,
    weight: str | None = None,
) -> DataFrame:
    """One row per group with a column per named probability.

    Continuous results interpolate at ``(n - 1) * p``; discrete ones take the nearest rank
    ``ceil(p * n)``. ``bounded_groups`` says the group columns range over a declared enumeration,
    so the brackets may be broadcast. ``accuracy`` is the number of parts an overfull bracket is cut into.
    A row counts as often as its ``weight``, a whole number above 0, says.
    """
    if not group:
        raise ValueError("Name at least one grouping column")
    names = list(probabilities)
    weights = [F.col(weight).cast("long").alias("_w")] if weight else []
    rows = F.sum("_w") if weight else F.count(F.lit(1))
    base = df.select(*group, *weights, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    measured = [rows.alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    histogram = base.groupBy(*group, _bucket(F.col("_v")).alias("_b")).agg(*measured)
    of_group = Window.partitionBy(*group)
    upto = F.sum("_c").over(of_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    placed = histogram.withColumns({"_before": upto - F.col("_c"), "_n": F.sum("_c").over(of_group)})
    targets = []
    for name in names:
        p = probabilities[name]
        n = F.col("_n").cast("double")
        position: Column = (
            F.greatest(F.lit(0.0), F.ceil(n * F.lit(p)).cast("double") - 1)
            if discrete
            else (n - 1) * F.lit(p)
        )
        lower = F.floor(position).cast("double")
        for i, rank in enumerate((lower, F.least(lower + 1, n - 1))):
            targets.append(
                F.struct(F.lit(name).alias("_name"), F.lit(i).alias("_i"), rank.alias("_k"), (position - lower).alias("_frac"))
            )

    def holds(before: Column) -> Column:
        return (F.col("_k") >= before) & (F.col("_k") < before + F.col("_c"))

    bracket = ["_lo", "_hi", "_c", "_before"]
    wanted = ["_name", "_i", "_k", "_frac"]
    brackets = cut_lineage(
        placed.select(*group, *bracket, F.inline(F.array(*targets))).where(holds(F.col("_before")))
    )

    def inside(chosen: DataFrame) -> DataFrame:
        """The values in the chosen brackets; brackets of a group are equal or apart."""
        apart = chosen.select(*group, "_lo", "_hi", "_before").distinct()
        apart = F.broadcast(apart) if bounded_groups else broadcast_if_small(apart)
        return base.join(apart, list(group)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    # Every cut parts the least value from the greatest, so this ends; values beyond all numbers stay together.
    overfull = (F.col("_c") > BRACKET_ROWS) & (F.col("_lo") < F.col("_hi")) & (F.col("_hi") < float("inf")) & (F.col("_lo") > float("-inf"))
    while not brackets.where(overfull).isEmpty():
        wide = brackets.where(overfull)
        part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * accuracy)
        parts = inside(wide).groupBy(*group, F.col("_before").alias("_first"), F.least(part, F.lit(accuracy - 1)).alias("_b")).agg(*measured)
        order = Window.partitionBy(*group, "_first").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("_before", F.col("_first") + F.sum("_c").over(order) - F.col("_c"))
        ranks = wide.select(*group, F.col("_before").alias("_first"), *wanted)
        cut = parts.join(ranks, [*group, "_first"]).where(holds(F.col("_before")))
        columns = [*group, *bracket, *wanted]
        brackets = cut_lineage(brackets.where(~overfull).select(*columns).unionByName(cut.select(*columns)))

    counted = inside(brackets).groupBy(*group, "_before", "_v").agg(rows.alias("_c"))
    order = Window.partitionBy(*group, "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    running = counted.withColumn("_below", F.col("_before") + F.sum("_c").over(order) - F.col("_c"))
    found = running.join(brackets.select(*group, "_before", *wanted), [*group, "_before"]).where(holds(F.col("_below")))
    picked = (
        found.groupBy(*group, "_name")
        .agg(
            F.max(F.when(F.col("_i") == 0, F.col("_v"))).alias("_v0"),
            F.max(F.when(F.col("_i") == 1, F.col("_v"))).alias("_v1"),
            F.first("_frac").alias("_frac"),
        )
        .select(
            *group,
            "_name",
            F.when(
                F.col("_v0").isNull() | (F.col("_v1").isNull() & (F.col("_frac") > 0)),
                F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
            )
            .when(F.col("_frac") > 0, F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_frac"))
            .otherwise(F.col("_v0"))
            .alias("_q"),
        )
    )
    return picked.groupBy(*group).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in names]
    )


def global_value_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each group with their count and the number of smaller rows.

    Values are pre-counted, then cut at sketch boundaries into ordered buckets, so the running
    count is taken bucket by bucket and shifted by the buckets before it. Columns: group, value,
    ``value_count``, ``rows_before``, ``group_rows``.
    """
    counts = cut_lineage(
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("value_count"))
    )
    buckets = max(RANK_BUCKETS, counts.count() // ROWS_PER_BUCKET + 1)
    cuts = broadcast_if_small(
        counts.groupBy(*group).agg(
            F.percentile_approx(
                value,
                F.array(*[F.lit(i / buckets) for i in range(1, buckets)]),
                F.lit(max(1000, 4 * buckets)),
            ).alias("_cuts")
        )
    )
    placed = (
        counts.join(cuts, list(group))
        .withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
        .drop("_cuts")
    )
    per_bucket = placed.groupBy(*group, "_bucket").agg(F.sum("value_count").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_bucket")
    offsets = per_bucket.select(
        *group,
        "_bucket",
        (F.sum("_rows").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias(
            "_offset"
        ),
        F.sum("_rows").over(Window.partitionBy(*group)).alias("group_rows"),
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(value)
    return (
        placed.join(broadcast_if_small(offsets), [*group, "_bucket"])
        .withColumn(
            "rows_before",
            F.col("_offset")
            + F.sum("value_count").over(inside.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("value_count"),
        )
        .select(*group, value, "value_count", "rows_before", "group_rows")
    )


def asof_lookup(
    steps: DataFrame, probes: DataFrame, group: Sequence[str], key: str, payload: str
) -> DataFrame:
    """Attach to every probe the payload of the last step at or before its key.

    Steps are cut at sketch boundaries per group; each bucket starts from the last step of the
    buckets before it, so no group is sorted in one task. Probes keep all their columns.
    """
    cuts = steps.groupBy(*group).agg(
        F.percentile_approx(
            key, F.array(*[F.lit(i / RANK_BUCKETS) for i in range(1, RANK_BUCKETS)]), F.lit(1000)
        ).alias("_cuts")
    )

    def place(df: DataFrame) -> DataFrame:
        return (
            df.join(cuts, list(group))
            .withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(key))))
            .drop("_cuts")
        )

    placed = place(steps.select(*group, key, payload))
    newest = placed.groupBy(*group, "_bucket").agg(
        F.max(F.struct(F.col(key).alias("k"), F.col(payload).alias("p"))).alias("_last")
    )
    slots = cuts.select(
        *group, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_bucket")
    ).join(newest, [*group, "_bucket"], "left")
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(
        *group, "_bucket", F.max("_last").over(earlier)["p"].alias("_carried")
    )
    located = place(probes)
    columns = [c for c in located.columns if c not in (*group, "_bucket", key)]
    timeline = located.select(
        *group, "_bucket", key, F.lit(1).alias("_kind"), F.struct(*columns).alias("_probe"),
        F.lit(None).cast(steps.schema[payload].dataType).alias("_p"),
    ).unionByName(
        placed.select(
            *group, "_bucket", key, F.lit(0).alias("_kind"),
            F.lit(None).cast(located.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("_probe"),
            F.col(payload).alias("_p"),
        )
    )
    seen = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(key, "_kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        timeline.withColumn("_here", F.last("_p", ignorenulls=True).over(seen))
        .where("_kind = 1")
        .join(carried, [*group, "_bucket"])
        .select(*group, key, "_probe.*", F.coalesce("_here", "_carried").alias(payload))
    )
