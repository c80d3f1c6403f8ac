"""Small column helpers shared by every report."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 6) -> Column:
    """Round last, and never report a negative zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def ratio_or_default(numerator: Column, denominator: Column, epsilon: float = 0.0) -> Column:
    """Growth ratio; 2 when growing from nothing and 1 when both sides are empty."""
    return (
        F.when(denominator > epsilon, rounded(numerator / denominator, 9))
        .when(numerator > epsilon, F.lit(2.0))
        .otherwise(F.lit(1.0))
    )


def normal_quantile(probability: float) -> float:
    """Standard Normal inverse CDF; Spark has no built-in, so it enters plans as a literal."""
    return NormalDist().inv_cdf(probability)
