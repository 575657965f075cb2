"""Conformal thresholds and interval scores.  Four quantile rules, never shared: see each function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip


def _kth(df: DataFrame, by: list[str], value: str, k: Column, name: str) -> DataFrame:
    """The k-th smallest value of each group, where k is an expression of n; null values don't count."""
    from .hierarchy import order_statistics

    return order_statistics(df, by, value, {name: k})


def split_conformal_radius(df: DataFrame, by: list[str], residual: Column, coverage: float) -> DataFrame:
    """Order statistic ceil((n + 1) coverage) of the absolute residuals, kept within 1..n."""
    k = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil((F.col("n") + 1) * F.lit(coverage).cast("double"))))
    return _kth(df.withColumn("_a", F.abs(residual)), by, "_a", k, "radius")


def cqr_score(low: Column, high: Column, target: Column) -> Column:
    return F.greatest(low - target, target - high)


def cqr_threshold(df: DataFrame, by: list[str], score: Column, coverage: float) -> DataFrame:
    """The 'higher' quantile at min(1, ceil((n + 1) c) / n): one order statistic above the radius rule; at least 0."""
    k = F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(coverage).cast("double")) + 1)
    return _kth(df.withColumn("_s", score), by, "_s", k, "_t").withColumn("threshold", F.greatest(F.lit(0.0), F.col("_t"))).drop("_t")


def balanced_threshold(df: DataFrame, by: list[str], score: str, weight: str, coverage: float) -> DataFrame:
    """Weighted 'higher' quantile of the scores, so that every user counts the same; at least 0."""
    from .hierarchy import weighted_quantile_higher

    return weighted_quantile_higher(df, by, score, weight, coverage).withColumn("threshold", F.greatest(F.lit(0.0), F.col("quantile"))).drop("quantile")


def bounds(low: Column, high: Column, adjust: Column, least: float, most: float) -> tuple[Column, Column]:
    return clip(low - adjust, least, most), clip(high + adjust, least, most)


def interval_score(low: Column, high: Column, target: Column, alpha: float) -> Column:
    """Width plus 2 / alpha times how far the target lies outside."""
    return (high - low) + F.lit(2 / alpha) * F.greatest(low - target, F.lit(0.0)) + F.lit(2 / alpha) * F.greatest(target - high, F.lit(0.0))


def weighted_interval_score(median: Column, target: Column, intervals: list[tuple[float, Column, Column]]) -> Column:
    """(half the absolute error of the median + sum of alpha / 2 * interval score) / (K + 1/2)."""
    total = F.lit(0.5) * F.abs(target - median)
    for alpha, low, high in intervals:
        total = total + F.lit(alpha / 2) * interval_score(low, high, target, alpha)
    return total / F.lit(len(intervals) + 0.5)


def pinball(target: Column, quantiles: list[tuple[float, Column]]) -> Column:
    """Mean pinball loss over the quantile levels."""
    total = F.lit(0.0)
    for q, x in quantiles:
        total = total + F.greatest(F.lit(q) * (target - x), F.lit(q - 1) * (target - x))
    return total / F.lit(float(len(quantiles)))


def inside(low: Column, high: Column, target: Column) -> Column:
    return ((target >= low) & (target <= high)).cast("double")
