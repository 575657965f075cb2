"""Irregular signals: quality, gaps, grids, last value in a bin, as-of interpolation, speeds.

A signal is a long table (session columns, ts in seconds, value); arrays appear only at the edges.
Every window is partitioned by session, the unit that stays small however much data there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import bin_end, haversine_km, in_range


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp, to the microsecond."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def sessions_by_gap(events: DataFrame, user: str, ts: str, gap: float, tie: str) -> DataFrame:
    """Adds session_no per user: a new session starts after a gap longer than `gap` seconds."""
    order = Window.partitionBy(user).orderBy(ts, tie)
    fresh = F.when(F.col(ts) - F.lag(ts).over(order) <= gap, 0).otherwise(1)
    return events.withColumn("_new", fresh).withColumn(
        "session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def gap_statistics(signal: DataFrame, by: list[str], ts: str, order: str, long_gap: float) -> DataFrame:
    """Differences of neighbours in file order: how many aren't positive, median, greatest, and how many are long."""
    step = signal.withColumn("d", F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy(order)))
    positive = F.when(F.col("d") > 0, F.col("d"))
    return step.groupBy(*by).agg(
        F.count("*").alias("points"),
        F.coalesce(F.sum((F.col("d") <= 0).cast("long")), F.lit(0)).alias("non_positive"),
        F.median(positive).alias("median_gap"), F.max(positive).alias("max_gap"),
        F.coalesce(F.sum((F.col("d") > long_gap).cast("long")), F.lit(0)).alias("long_gaps"))


def quality(signal: DataFrame, by: list[str], ts: str, value: str, order: str, low: float, high: float,
            shortest: float, longest: float, coverage: float, long_gap: float) -> DataFrame:
    """One row a session: span, valid share, gaps, and whether the signal is eligible."""
    ok = in_range(F.col(value), low, high)
    base = signal.groupBy(*by).agg(
        F.min_by(ts, order).alias("first_ts"), F.max_by(ts, order).alias("last_ts"),
        F.sum(ok.cast("long")).alias("valid"), F.median(F.when(ok, F.col(value))).alias("median_value"))
    out = base.join(gap_statistics(signal, by, ts, order, long_gap), by)
    duration = F.col("last_ts") - F.col("first_ts")
    share = F.col("valid") / F.col("points")
    return out.withColumn("duration", duration).withColumn("coverage", share).withColumn(
        "eligible", duration.between(shortest, longest) & (share >= coverage) & (F.col("non_positive") == 0))


def last_in_bin(signal: DataFrame, by: list[str], ts: str, value: str, grid: float, order: str | None = None) -> DataFrame:
    """(by, bin, value): the last value in each right-closed bin; a partial aggregate, no sort."""
    at = F.struct(F.col(ts), F.col(order)) if order else F.col(ts)
    return signal.withColumn("bin", bin_end(F.col(ts), grid)).groupBy(*by, "bin").agg(F.max_by(value, at).alias("value"))


def masked_summary(signal: DataFrame, by: list[str], value: str, ok: Column) -> DataFrame:
    """Mean, population deviation and count of the valid values; 0, 0, 0 if there is none."""
    v = F.when(ok, F.col(value))
    return signal.groupBy(*by).agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("sd"),
        F.count(v).alias("n"))


def bracketed(signal: DataFrame, probes: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Adds to every probe the last point at or before it and the first at or after it (t0, v0, t1, v1).

    One union sorted within the session replaces a range join; points and probes at the same
    time meet because points sort first in either direction.
    """
    points = signal.select(*by, F.col(ts).alias("t"), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")).alias("p"), F.lit(0).alias("probe"))
    wanted = probes.withColumn("t", F.col(ts)).withColumn("probe", F.lit(1))
    both = points.unionByName(wanted, allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy("t", "probe").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.col("t").desc(), "probe").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_a", F.last("p", True).over(before)).withColumn("_b", F.last("p", True).over(after)).where("probe = 1")
    return out.select(*probes.columns, F.col("_a.t").alias("t0"), F.col("_a.v").alias("v0"), F.col("_b.t").alias("t1"), F.col("_b.v").alias("v1"))


def interpolated(bracket: DataFrame, ts: str, max_span: float, low: float, high: float) -> DataFrame:
    """Adds span and interpolated: exact hits have span 0; else brackets up to max_span apart, the result valid again."""
    span = F.col("t1") - F.col("t0")
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(ts) - F.col("t0")) / F.nullif(span, F.lit(0.0))
    got = F.when(F.col("t0") == F.col(ts), F.col("v0")).when((span > 0) & (span <= max_span) & line.between(low, high), line)
    return bracket.withColumn("interpolated", got).withColumn("span", F.when(got.isNotNull(), F.when(F.col("t0") == F.col(ts), 0.0).otherwise(span)))


def gps_speed(track: DataFrame, by: list[str], ts: str, lat: str, lon: str, longest: float = 60.0, top: float = 200.0) -> DataFrame:
    """km/h between neighbours; null unless the step, both places and the speed are plausible."""
    w = Window.partitionBy(*by).orderBy(ts)
    dt = F.col(ts) - F.lag(ts).over(w)
    ok = lambda a, o: in_range(a, -90, 90) & in_range(o, -180, 180)
    prev = [F.lag(c).over(w) for c in (lat, lon)]
    step = track.withColumn("_dt", dt).withColumn("_a", prev[0]).withColumn("_o", prev[1])
    km = haversine_km(F.col("_a"), F.col("_o"), F.col(lat), F.col(lon))
    speed = km * 3600 / F.nullif(F.col("_dt"), F.lit(0.0))
    fine = (F.col("_dt") > 0) & (F.col("_dt") <= longest) & ok(F.col("_a"), F.col("_o")) & ok(F.col(lat), F.col(lon))
    return step.withColumn("speed", F.when(fine & speed.between(0, top), speed)).drop("_dt", "_a", "_o")


def distance_speed(track: DataFrame, by: list[str], ts: str, km: str, longest: float = 60.0, top: float = 200.0) -> DataFrame:
    """km/h from a cumulative distance that must not fall."""
    w = Window.partitionBy(*by).orderBy(ts)
    step = track.withColumn("_dt", F.col(ts) - F.lag(ts).over(w)).withColumn("_d", F.col(km) - F.lag(km).over(w))
    speed = F.col("_d") * 3600 / F.nullif(F.col("_dt"), F.lit(0.0))
    fine = (F.col("_dt") > 0) & (F.col("_dt") <= longest) & (F.col("_d") >= 0)
    return step.withColumn("speed", F.when(fine & speed.between(0, top), speed)).drop("_dt", "_d")


def chosen_speed(track: DataFrame, by: list[str], direct: str, derived: str, low: float = 0.0, high: float = 200.0) -> DataFrame:
    """The direct channel for sessions where it has any valid value, else the derived one."""
    any_valid = F.max(in_range(F.col(direct), low, high)).over(Window.partitionBy(*by))
    return track.withColumn("speed_source", F.when(any_valid, "direct").otherwise("derived")).withColumn(
        "speed", F.when(F.col("speed_source") == "direct", F.col(direct)).otherwise(F.col(derived)))
