"""Numeric expressions with the rules fixed in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in km.
EARTH_KM = 6371.0088


def finite(x: Column) -> Column:
    """x, with NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def in_range(x: Column, low: float, high: float) -> Column:
    """True only for finite values within [low, high]; null counts as outside."""
    return F.coalesce(finite(x).between(low, high), F.lit(False))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def bin_end(t: Column, grid: float) -> Column:
    """Index of the right-closed bin ((k-1)g, kg] that holds t."""
    return F.ceil(t / F.lit(float(grid))).cast("long")


def grid_count(start: Column, end: Column, grid: float) -> Column:
    return bin_end(end, grid) - bin_end(start, grid) + 1


def stride_up(x: Column, stride: float) -> Column:
    """Least multiple of stride that is not below x."""
    return F.ceil(x / F.lit(float(stride))) * F.lit(float(stride))


def context_bin(t: Column, start: Column, context: float, grid: float) -> Column:
    """0-based bin of t in (start, start + context]; null outside, so also at start itself."""
    rel = t - start
    return F.when((rel > 0) & (rel <= context), F.ceil(rel / F.lit(float(grid))).cast("long") - 1)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def quantized(x: Column, offset: float, step: float) -> Column:
    """Nearest multiple number of step after an offset, halves to even."""
    return F.rint((x + F.lit(float(offset))) / F.lit(float(step))).cast("int")
