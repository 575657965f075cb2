"""Fixed-length profiles of session signals, and whether a session has enough signal for one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resampled(values: Column, points: int) -> Column:
    """An array at `points` equally spaced places of another, linear in between, its ends kept."""
    n = F.size(values)
    place = lambda i: i.cast("double") * (n - 1) / F.lit(float(max(points - 1, 1)))

    def at(i: Column) -> Column:
        low = F.floor(place(i)).cast("int")
        a = F.element_at(values, low + 1).cast("double")
        b = F.element_at(values, F.least(low + 2, n)).cast("double")
        return a + (b - a) * (place(i) - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def resampled_rows(x: np.ndarray, points: int) -> np.ndarray:
    """The same for the rows of an array."""
    place = np.arange(points) * float(x.shape[1] - 1) / float(max(points - 1, 1))
    low = np.floor(place).astype(np.int64)
    a = x[:, low]
    return a + (x[:, np.minimum(low + 1, x.shape[1] - 1)] - a) * (place - low)


def eligibility(bins: DataFrame, by: list[str], least_span: int, coverage: float, longest_gap: int, least_sd: float) -> DataFrame:
    """(by, span, coverage, missing_run, sd, reason): the first rule a session's observed bins break, null if none."""
    order = Window.partitionBy(*by).orderBy("bin")
    steps = bins.withColumn("_gap", F.col("bin") - F.lag("bin").over(order) - 1)
    s = steps.groupBy(*by).agg(
        (F.max("bin") - F.min("bin") + 1).alias("span"), F.count("*").alias("_n"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("missing_run"), F.stddev_pop("value").alias("sd"))
    share = F.col("_n") / F.col("span")
    reason = (
        F.when(F.col("span") < least_span, "span_too_short").when(share < coverage, "coverage")
        .when(F.col("missing_run") > longest_gap, "missing_run").when(F.col("sd") < least_sd, "flat_signal"))
    return s.select(*by, "span", share.alias("coverage"), "missing_run", "sd", reason.alias("reason"))


def variants(values: Column, crops: list[float], offsets: list[float], step: float, points: int) -> Column:
    """Distinct digests of the cropped, resampled and quantised profile, one for each crop and offset."""
    from ..functions.numeric import quantized

    n = F.size(values)
    out = []
    for crop in crops:
        cut = F.floor(n * F.lit(crop)).cast("int")
        part = F.slice(values, cut + 1, F.greatest(n - 2 * cut, F.lit(1)))
        for offset in offsets:
            level = (lambda o: lambda x: quantized(x, o, step).cast("string"))(offset)
            q = F.transform(resampled(part, points), level)
            out.append(F.sha2(F.array_join(q, ",").cast("binary"), 256))
    return F.array_distinct(F.array(*out))


def across_sources(left: DataFrame, right: DataFrame, key: str, digest: Column) -> DataFrame:
    """(left_key, right_key) of equal digests: each side's keys of a digest are represented by their least one, so
    two large groups of copies meet in one row."""
    one = lambda df, name: df.withColumn("digest", digest).groupBy("digest").agg(
        F.min(key).alias(f"{name}_key"), F.count("*").alias(f"{name}_n"))
    return one(left, "left").join(one(right, "right"), "digest")
