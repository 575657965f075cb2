"""Forecast origins: past-only contexts, multi-horizon targets, rejection reasons, forecasts and features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import bin_end, clip, context_bin, in_range, stride_up
from .series import bracketed, interpolated


@dataclass(frozen=True)
class TimeProfile:
    """Time constants in seconds; the defaults are those of a ten-second grid (fixed values)."""

    context: float = 300.0
    grid: float = 10.0
    stride: float = 60.0
    evaluation_stride: float = 300.0
    horizons: tuple[float, ...] = (60.0, 180.0, 300.0)
    coverage: float = 0.80
    max_gap: float = 60.0
    max_span: float = 30.0
    low: float = 30.0
    high: float = 240.0

    @property
    def bins(self) -> int:
        return int(self.context // self.grid)

    def __post_init__(self):
        if min(self.horizons) <= self.max_span:
            raise ValueError("a target's bracket could start before its origin: the span must be under every horizon")


DAY = 86_400.0
#: For signals with some two points a day.
DAILY = TimeProfile(context=5 * DAY, grid=DAY, stride=DAY, evaluation_stride=2 * DAY, horizons=(DAY, 2 * DAY, 3 * DAY),
                    coverage=0.8, max_gap=1.5 * DAY, max_span=0.9 * DAY, low=0.0, high=500.0)


def _doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def session_reasons(signal: DataFrame, by: list[str], ts: str, value: str, order: str, profile: TimeProfile) -> DataFrame:
    """One row a session: start, end, candidate range, and the reason to reject it whole, if any."""
    d = F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy(order))
    ok = in_range(F.col(value), profile.low, profile.high)
    s = signal.withColumn("_d", d).groupBy(*by).agg(
        F.count("*").alias("points"), F.min(F.coalesce(F.col("_d"), F.lit(1.0))).alias("least_step"),
        F.sum(ok.cast("long")).alias("valid"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    first = stride_up(F.col("start") + profile.context, profile.stride)
    last = F.col("end") - max(profile.horizons)
    reason = (
        F.when(F.col("points") < 2, "invalid_or_unaligned_arrays")
        .when(F.col("least_step") <= 0, "non_monotonic_timestamps")
        .when(F.col("valid") < 2, "insufficient_valid_hr")
        .when(first > last, "session_too_short_after_alignment")
    )
    return s.withColumn("first_origin", first).withColumn("last_origin", last).withColumn("reason", reason)


def candidates(sessions: DataFrame, by: list[str], profile: TimeProfile, origin: str = "origin") -> DataFrame:
    """All stride-aligned origins of the sessions that aren't rejected."""
    steps = F.sequence(F.col("first_origin").cast("long"), F.floor("last_origin").cast("long"), F.lit(int(profile.stride)))
    return sessions.where("reason is null").select(*by, "start", F.explode(_doubles(steps)).alias(origin))


def origins(signal: DataFrame, by: list[str], ts: str, value: str, order: str, profile: TimeProfile) -> DataFrame:
    """Every candidate origin with context statistics, targets and the first reason that rejects it (null: accepted).

    Contexts are joined by cell: a point lies in the contexts of at most context / stride + 1 origins, which it
    names itself, so the join is an equi-join on (session, origin) instead of a range join.
    """
    p = profile
    sessions = session_reasons(signal, by, ts, value, order, p)
    wanted = candidates(sessions, by, p)
    valid = signal.where(in_range(F.col(value), p.low, p.high)).select(*by, F.col(ts).alias("t"), F.col(value).alias("v"))
    # Closed on both sides: a point exactly at the start counts for gaps, not for bins.
    reach = F.sequence(stride_up(F.col("t"), p.stride).cast("long"),
                       (F.floor((F.col("t") + p.context) / p.stride) * p.stride).cast("long"), F.lit(int(p.stride)))
    first, last = stride_up(F.col("t"), p.stride), F.floor((F.col("t") + p.context) / p.stride) * p.stride
    spread = valid.where(first <= last).withColumn("origin", F.explode(_doubles(reach)))
    w = Window.partitionBy(*by, "origin").orderBy("t")
    near = spread.join(wanted.select(*by, "origin"), [*by, "origin"]).withColumn("_step", F.col("t") - F.lag("t").over(w))
    context = near.groupBy(*by, "origin").agg(
        F.count("*").alias("raw_points"), F.max("_step").alias("_step"), F.min("t").alias("_first"), F.max("t").alias("input_last"),
        F.countDistinct(context_bin(F.col("t"), F.col("origin") - p.context, p.context, p.grid)).alias("bins"))
    gap = F.greatest(F.col("_first") - (F.col("origin") - p.context), F.col("origin") - F.col("input_last"), F.coalesce("_step", F.lit(0.0)))
    out = wanted.join(context, [*by, "origin"], "left").withColumn("coverage", F.coalesce("bins", F.lit(0)) / p.bins).withColumn("max_gap", gap)

    probes = wanted.select(*by, "origin").withColumn(
        "h", F.explode(F.array(*[F.lit(float(h)) for h in p.horizons]))).withColumn("t", F.col("origin") + F.col("h"))
    hit = interpolated(bracketed(valid, probes, by, "t", "v"), "t", p.max_span, p.low, p.high)
    targets = hit.groupBy(*by, "origin").agg(
        *[F.max(F.when(F.col("h") == h, F.col("interpolated"))).alias(f"target_{i}") for i, h in enumerate(p.horizons, 1)],
        *[F.max(F.when(F.col("h") == h, F.col("span"))).alias(f"span_{i}") for i, h in enumerate(p.horizons, 1)])
    out = out.join(targets, [*by, "origin"], "left")
    reason = F.when(F.col("raw_points").isNull(), "empty_context").when(F.col("coverage") < p.coverage, "context_bin_coverage").when(
        F.col("max_gap") > p.max_gap, "context_gap")
    for i in range(1, len(p.horizons) + 1):
        reason = reason.when(F.col(f"target_{i}").isNull(), f"target_{i}_unavailable")
    return out.withColumn("reason", reason).withColumn("evaluation", F.col("origin") % p.evaluation_stride == 0).drop("_step", "_first")


def rejections(session_rows: DataFrame, origin_rows: DataFrame) -> DataFrame:
    """(reason, n) over whole sessions and origins; accepted origins count under `accepted`."""
    whole = session_rows.where("reason is not null").select("reason")
    return whole.unionByName(origin_rows.select(F.coalesce("reason", F.lit("accepted")).alias("reason"))).groupBy("reason").agg(
        F.count("*").alias("n"))


def contexts(bins: DataFrame, wanted: DataFrame, by: list[str], profile: TimeProfile) -> DataFrame:
    """(by, origin, pos, value): the observed bins of each origin's context, pos 0 oldest.

    A bin names the origins whose context holds it, so this too is an equi-join."""
    n, g = profile.bins, profile.grid
    end = F.col("bin").cast("double") * g
    first = stride_up(end, profile.stride)
    last = F.floor((end + (n - 1) * g) / profile.stride) * profile.stride
    spread = bins.where(first <= last).withColumn(
        "origin", F.explode(_doubles(F.sequence(first.cast("long"), last.cast("long"), F.lit(int(profile.stride))))))
    joined = spread.join(wanted.select(*by, "origin"), [*by, "origin"])
    return joined.withColumn("pos", (F.lit(n - 1) - (bin_end(F.col("origin"), g) - F.col("bin"))).cast("int"))


def ewma(values: Column, alpha: float, low: float, high: float) -> Column:
    """Exponentially weighted mean over an array: starts with the first value, clipped only at the end."""
    step = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))), F.element_at(values, 1),
                       lambda acc, x: F.lit(alpha) * x + F.lit(1.0 - alpha) * acc)
    return clip(F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise(step), low, high)


def forecasts(context: DataFrame, by: list[str], profile: TimeProfile, alpha: float) -> DataFrame:
    """(by, origin, horizon, persistence, ewma, trend) from the observed bins."""
    x = (F.col("pos") - (profile.bins - 1)) * F.lit(profile.grid)
    g = context.withColumn("x", x).groupBy(*by, "origin").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("pairs"), F.max_by("value", "pos").alias("persistence"),
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("value").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("x") * F.col("value")).alias("sxy"))
    g = g.withColumn("ewma", ewma(F.transform("pairs", lambda p: p["value"]), alpha, profile.low, profile.high))
    g = g.withColumn("h", F.explode(F.array(*[F.lit(float(h)) for h in profile.horizons])))
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(den, F.lit(0.0))
    line = clip(F.col("sy") / F.col("n") + slope * (F.col("h") - F.col("sx") / F.col("n")), profile.low, profile.high)
    return g.withColumn("trend", F.when((F.col("n") < 2) | (den == 0), F.col("persistence")).otherwise(line)).select(
        *by, "origin", F.col("h").alias("horizon"), "persistence", "ewma", "trend")


def channel_features(context: DataFrame, by: list[str], profile: TimeProfile, recent: tuple[int, int]) -> DataFrame:
    """Ten statistics of each origin's context: level, spread, change, slope, coverage, recent means."""
    n = profile.bins
    x = (F.col("pos") - (n - 1)) * F.lit(profile.grid)
    c = context.withColumn("x", x)
    late = lambda k: F.avg(F.when(F.col("pos") >= n - k, F.col("value")))
    g = c.groupBy(*by, "origin").agg(
        F.max_by("value", "pos").alias("last"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", "pos").alias("_first"),
        F.count("*").alias("_n"), F.sum("x").alias("_sx"), F.sum("value").alias("_sy"), F.sum(F.col("x") * F.col("x")).alias("_sxx"),
        F.sum(F.col("x") * F.col("value")).alias("_sxy"), *[F.coalesce(late(k), F.lit(0.0)).alias(f"recent_{k}") for k in recent])
    den = F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    slope = F.when(F.abs(den) > 1e-8, (F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / F.nullif(den, F.lit(0.0))).otherwise(0.0)
    return g.withColumn("change", F.col("last") - F.col("_first")).withColumn("slope", slope).withColumn(
        "coverage", F.col("_n") / n).drop("_first", "_n", "_sx", "_sy", "_sxx", "_sxy")


def cohorts(rows: DataFrame, profile: TimeProfile) -> DataFrame:
    """(horizon, common, any, added): origins with all targets, with this target, and the difference."""
    good = rows.where("reason is null or reason like 'target_%'")
    every = None
    for i in range(1, len(profile.horizons) + 1):
        every = F.col(f"target_{i}").isNotNull() if every is None else every & F.col(f"target_{i}").isNotNull()
    stack = ", ".join(f"{i}, target_{i}" for i in range(1, len(profile.horizons) + 1))
    long = good.withColumn("every", every).selectExpr("every", f"stack({len(profile.horizons)}, {stack}) as (horizon, target)")
    return long.groupBy("horizon").agg(
        F.sum(F.col("every").cast("long")).alias("common"), F.count("target").alias("with_target"),
        F.sum((~F.col("every") & F.col("target").isNotNull()).cast("long")).alias("added"))


STATISTICS = ("last", "mean", "sd", "low", "high", "change", "slope", "coverage")


def feature_table(wanted: DataFrame, channels: dict[str, DataFrame], by: list[str], profile: TimeProfile, recent: tuple[int, int],
                  elapsed: Column, code: Column, codes: int = 8) -> DataFrame:
    """Ten statistics of each channel's context, log elapsed seconds and a column for each family code: 39 for three channels.

    wanted: one row an origin; channels: contexts.  An origin without any point of a channel has zeros there; a code beyond
    the last, or a null one, has zeros everywhere."""
    names = [*STATISTICS, *(f"recent_{k}" for k in recent)]
    out = wanted
    for channel, context in channels.items():
        found = channel_features(context, by, profile, recent).select(*by, "origin", *[F.col(n).alias(f"{channel}_{n}") for n in names])
        out = out.join(found, [*by, "origin"], "left")
    hot = [F.coalesce((code == i).cast("double"), F.lit(0.0)).alias(f"code_{i}") for i in range(codes)]
    filled = [F.coalesce(f"{c}_{n}", F.lit(0.0)).alias(f"{c}_{n}") for c in channels for n in names]
    return out.select(*by, "origin", *filled, F.log1p(elapsed).alias("log_elapsed"), *hot)


def without_channels(df: DataFrame, channels: list[str], keep: list[str]) -> DataFrame:
    """Signal ablation: feature columns of the channels that aren't kept are 0."""
    gone = tuple(f"{c}_" for c in channels if c not in keep)
    return df.withColumns({c: F.lit(0.0) for c in df.columns if gone and c.startswith(gone)})


def held_code(code: Column, held: int) -> Column:
    """A held-out family's code as the code of unknown families, 0."""
    return F.when(code == held, F.lit(0)).otherwise(code)


def cohort_errors(rows: DataFrame, persistence: DataFrame, by: list[str], profile: TimeProfile) -> DataFrame:
    """(by, origin, horizon, error, common): the error of each target that exists; common: all targets of the origin exist."""
    n = len(profile.horizons)
    every = F.col("target_1").isNotNull()
    for i in range(2, n + 1):
        every = every & F.col(f"target_{i}").isNotNull()
    stack = ", ".join(f"{h}D, target_{i}" for i, h in enumerate(profile.horizons, 1))
    long = rows.where("reason is null or reason like 'target_%'").withColumn("common", every).selectExpr(
        *by, "origin", "common", f"stack({n}, {stack}) as (horizon, target)").where("target is not null")
    return long.join(persistence, [*by, "origin", "horizon"]).withColumn("error", F.abs(F.col("persistence") - F.col("target")))


def extra_origins(rows: DataFrame, profile: TimeProfile) -> DataFrame:
    """Origins with some targets but not all, with a 0/1 mask of those they have."""
    masks = [F.col(f"target_{i}").isNotNull().cast("int") for i in range(1, len(profile.horizons) + 1)]
    total = masks[0]
    for m in masks[1:]:
        total = total + m
    return rows.where("reason like 'target_%'").withColumn("mask", F.array(*masks)).where((total > 0) & (total < len(masks)))


def cohort_comparison(errors: DataFrame, user: str, session: str) -> DataFrame:
    """(horizon, of both cohorts: users, sessions, origins, mae; retention, added, delta): equal weight to users and sessions."""
    def metrics(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        sessions = df.groupBy("horizon", user, session).agg(F.avg("error").alias("e"), F.count("*").alias("n"))
        users = sessions.groupBy("horizon", user).agg(F.avg("e").alias(f"{name}_mae"), F.count("*").alias("s"), F.sum("n").alias("n"))
        return users, users.groupBy("horizon").agg(
            F.count("*").alias(f"{name}_users"), F.sum("s").alias(f"{name}_sessions"), F.sum("n").alias(f"{name}_origins"), F.avg(f"{name}_mae").alias(f"{name}_mae"))

    _, common = metrics(errors.where("common"), "common")
    _, specific = metrics(errors, "specific")
    both = specific.join(common, "horizon")
    return both.withColumn("retention", F.col("common_origins") / F.col("specific_origins")).withColumn(
        "added", F.col("specific_origins") - F.col("common_origins")).withColumn("delta", F.col("specific_mae") - F.col("common_mae"))
