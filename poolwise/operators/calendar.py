"""Business days from the weekday and a table of holidays and make-up days.

The table has a row wherever the rule changes: ``from_day`` (a date) and ``business``: false where holidays begin,
true where make-up days begin, null where the weekday decides again. A day follows the last change up to it. Days
are few, whatever the trace, so the as-of lookup runs over distinct days and its result is joined by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import broadcast_if_small


def moment_of(seconds: Column, origin: str) -> Column:
    """Origin-relative seconds as a timestamp, to the microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(seconds * 1e6).cast("long"), F.lit(origin).cast("timestamp_ntz"))


def business_days(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """day, workday (0 or 1) of each distinct ``day``."""
    changes = calendar.select(F.col("from_day").cast("date").alias("day"), F.col("business").cast("boolean").alias("business"))
    # Of several changes on one day, a holiday counts before a make-up day, and either before the weekday.
    settled = changes.groupBy("day").agg(F.min("business").alias("business")).withColumn("change", F.lit(True))
    wanted = days.select(F.col("day").cast("date").alias("day")).distinct().withColumn("change", F.lit(False))
    both = wanted.unionByName(settled, allowMissingColumns=True)
    rule = F.struct("day", "business")
    since = F.last(F.when(F.col("change"), rule), ignorenulls=True).over(
        Window.orderBy("day", F.col("change").desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    by_weekday = F.weekday("day") < 5
    workday = F.coalesce(since["business"], by_weekday).cast("int")
    return both.select("day", "change", workday.alias("workday")).where(~F.col("change")).drop("change")


def time_categories(rows: DataFrame, seconds: str, origin: str, calendar: DataFrame | None = None) -> DataFrame:
    """``rows`` with workday (0 or 1), weekday (Monday is 0) and hour of ``seconds`` behind ``origin``."""
    moment = moment_of(F.col(seconds), origin)
    placed = rows.withColumns({"_day": moment.cast("date"), "weekday": F.weekday(moment).cast("int"), "hour": F.hour(moment).cast("int")})
    if calendar is None:
        return placed.withColumn("workday", (F.col("weekday") < 5).cast("int")).drop("_day")
    days = business_days(placed.select(F.col("_day").alias("day")), calendar).withColumnRenamed("day", "_day")
    return placed.join(broadcast_if_small(days), "_day", "left").drop("_day")


def day_flags(first_day: int, last_day: int, origin: str, calendar: DataFrame) -> DataFrame:
    """day_index, workday for the days from ``first_day`` to ``last_day`` behind the origin's midnight."""
    spark = calendar.sparkSession
    start = F.lit(origin).cast("timestamp_ntz").cast("date")
    span = spark.range(first_day, last_day + 1).select(F.col("id").alias("day_index"), F.date_add(start, F.col("id").cast("int")).alias("day"))
    return span.join(business_days(span, calendar), "day").select("day_index", "workday")
