"""Signals, origins, forecasts and features over the events of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import bin_end, context_bin, grid_count, haversine_km, in_range
from ..operators import hierarchy as h, origins as og, series as se
from .base import r6, rounded, table

P = og.DAILY
GAP = 2 * og.DAY
BY = ["user_id", "session_no"]


def signal(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", se.seconds(F.col("ts")).alias("t"), "value", "event_type")
    return se.sessions_by_gap(e, "user_id", "t", GAP, "event_id")


SIG = f"""e0 AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, event_type FROM events),
e1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM e0),
sig AS (SELECT user_id, event_id, t, value, event_type, (sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_no FROM e1)"""


def valid_range(spark, d):
    return signal(spark, d).groupBy("event_type").agg(F.sum(in_range(F.col("value"), 10, 200).cast("long")).alias("valid"), F.count("*").alias("n"))


VALID_RANGE = f"WITH {SIG} SELECT event_type, count(*) FILTER (value BETWEEN 10 AND 200) AS valid, count(*) AS n FROM sig GROUP BY ALL"


def gap_stats(spark, d):
    return rounded(se.gap_statistics(signal(spark, d), BY, "t", "event_id", 3600.0), "median_gap", "max_gap")


GAPS = f"""{SIG}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, session_no ORDER BY event_id) AS d FROM sig),
gs AS (SELECT user_id, session_no, count(*) AS points, count(*) FILTER (d <= 0) AS non_positive, median(d) FILTER (d > 0) AS median_gap, max(d) FILTER (d > 0) AS max_gap,
  count(*) FILTER (d > 3600) AS long_gaps FROM g GROUP BY ALL)"""
GAP_STATS = f"WITH {GAPS} SELECT user_id, session_no, points, non_positive, round(median_gap, 6) AS median_gap, round(max_gap, 6) AS max_gap, long_gaps FROM gs"


def quality_manifest(spark, d):
    q = se.quality(signal(spark, d), BY, "t", "value", "event_id", 10, 400, og.DAY, 40 * og.DAY, 0.8, 3600.0)
    return rounded(q, "first_ts", "last_ts", "duration", "coverage", "median_gap", "max_gap", "median_value")


QUALITY_MANIFEST = f"""WITH {GAPS}, b AS (SELECT user_id, session_no, arg_min(t, event_id) AS first_ts, arg_max(t, event_id) AS last_ts, count(*) FILTER (value BETWEEN 10 AND 400) AS valid,
  median(value) FILTER (value BETWEEN 10 AND 400) AS median_value FROM sig GROUP BY ALL)
SELECT user_id, session_no, round(first_ts, 6) AS first_ts, round(last_ts, 6) AS last_ts, valid, round(median_value, 6) AS median_value, points, non_positive,
  round(median_gap, 6) AS median_gap, round(max_gap, 6) AS max_gap, long_gaps, round(last_ts - first_ts, 6) AS duration, round(valid / points, 6) AS coverage,
  (last_ts - first_ts) BETWEEN {og.DAY} AND {40 * og.DAY} AND valid / points >= 0.8::DOUBLE AND non_positive = 0 AS eligible FROM b JOIN gs USING (user_id, session_no)"""


def _bins(spark, d):
    s = signal(spark, d).where(in_range(F.col("value"), P.low, P.high))
    return se.last_in_bin(s, BY, "t", "value", P.grid, "event_id")


def last_in_bin(spark, d):
    return _bins(spark, d)


BINS = f"""{SIG}, bins AS (SELECT user_id, session_no, ceil(t / {P.grid})::BIGINT AS bin, arg_max(value, struct_pack(t := t, e := event_id)) AS value
  FROM sig WHERE value BETWEEN {P.low} AND {P.high} GROUP BY ALL)"""
LAST_IN_BIN = f"WITH {BINS} SELECT user_id, session_no, bin, value FROM bins"


def grid_bins(spark, d):
    s = signal(spark, d).groupBy(*BY).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return s.select(*BY, bin_end(F.col("a"), P.grid).alias("first_bin"), grid_count(F.col("a"), F.col("b"), P.grid).alias("n_bins"),
                    context_bin(F.col("b"), F.col("a"), P.context, P.grid).alias("last_context_bin"))


GRID_BINS = f"""WITH {SIG}, s AS (SELECT user_id, session_no, min(t) AS a, max(t) AS b FROM sig GROUP BY ALL)
SELECT user_id, session_no, ceil(a / {P.grid})::BIGINT AS first_bin, (ceil(b / {P.grid}) - ceil(a / {P.grid}) + 1)::BIGINT AS n_bins,
  CASE WHEN b - a > 0 AND b - a <= {P.context} THEN ceil((b - a) / {P.grid})::BIGINT - 1 END AS last_context_bin FROM s"""


def session_summary(spark, d):
    return rounded(se.masked_summary(signal(spark, d), BY, "value", in_range(F.col("value"), 20, 80)), "mean", "sd")


SESSION_SUMMARY = f"""WITH {SIG} SELECT user_id, session_no, round(coalesce(avg(value) FILTER (value BETWEEN 20 AND 80), 0), 6) AS mean,
  round(coalesce(stddev_pop(value) FILTER (value BETWEEN 20 AND 80), 0), 6) AS sd, count(value) FILTER (value BETWEEN 20 AND 80) AS n FROM sig GROUP BY ALL"""


def asof_interpolate(spark, d):
    s = signal(spark, d)
    ends = s.groupBy(*BY).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    probes = ends.select(*BY, F.explode(F.transform(F.sequence(
        (F.floor(F.col("a") / og.DAY) * og.DAY).cast("long"), F.col("b").cast("long"), F.lit(86400)), lambda x: x.cast("double"))).alias("probe_t"))
    once = s.groupBy(*BY, "t").agg(F.max("value").alias("value"))
    got = se.interpolated(se.bracketed(once.withColumnRenamed("t", "probe_t"), probes, BY, "probe_t", "value"), "probe_t", og.DAY, 0.0, 500.0)
    return got.select(*BY, r6("probe_t").alias("probe_t"), r6("interpolated").alias("interpolated"), r6("span").alias("span"))


ASOF = f"""WITH {SIG}, o AS (SELECT user_id, session_no, t, max(value) AS v FROM sig GROUP BY ALL), s AS (SELECT user_id, session_no, min(t) AS a, max(t) AS b FROM sig GROUP BY ALL),
p AS (SELECT user_id, session_no, unnest(range((floor(a / 86400) * 86400)::BIGINT, floor(b)::BIGINT + 1, 86400))::DOUBLE AS probe_t FROM s),
l AS (SELECT p.*, o.t AS t0, o.v AS v0 FROM p ASOF LEFT JOIN o ON p.user_id = o.user_id AND p.session_no = o.session_no AND p.probe_t >= o.t),
r AS (SELECT l.*, o.t AS t1, o.v AS v1 FROM l ASOF LEFT JOIN o ON l.user_id = o.user_id AND l.session_no = o.session_no AND l.probe_t <= o.t),
i AS (SELECT *, CASE WHEN t0 = probe_t THEN v0 WHEN t1 - t0 > 0 AND t1 - t0 <= 86400 AND v0 + (v1 - v0) * (probe_t - t0) / nullif(t1 - t0, 0) BETWEEN 0 AND 500 THEN v0 + (v1 - v0) * (probe_t - t0) / nullif(t1 - t0, 0) END AS x FROM r)
SELECT user_id, session_no, round(probe_t, 6) AS probe_t, round(x, 6) AS interpolated, round(CASE WHEN x IS NOT NULL THEN CASE WHEN t0 = probe_t THEN 0 ELSE t1 - t0 END END, 6) AS span FROM i"""


def _track(spark, d):
    return signal(spark, d).withColumns({"lat": 40 + F.col("value") / 1e5, "lon": 10 + (F.col("event_id") % 100) / 1e5})


def haversine(spark, d):
    return _track(spark, d).groupBy("event_type").agg(
        r6(F.avg(haversine_km(F.lit(40.0), F.lit(10.0), F.col("lat"), F.col("lon")))).alias("km"))


_HAV = "12742.0176::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
TRACK = f"{SIG}, tr AS (SELECT *, 40 + value / 1e5 AS lat, 10 + (event_id % 100) / 1e5 AS lon FROM sig)"
HAVERSINE = f"WITH {TRACK} SELECT event_type, round(avg({_HAV.format('40.0::DOUBLE', '10.0::DOUBLE', 'lat', 'lon')}), 6) AS km FROM tr GROUP BY ALL"


def gps_speed(spark, d):
    s = se.gps_speed(_track(spark, d), BY, "t", "lat", "lon", longest=7200.0)
    return s.groupBy("event_type").agg(F.count("speed").alias("n"), r6(F.avg("speed")).alias("speed"))


GPS_SPEED = f"""WITH {TRACK}, l AS (SELECT *, t - lag(t) OVER w AS dt, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM tr WINDOW w AS (PARTITION BY user_id, session_no ORDER BY t)),
s AS (SELECT event_type, CASE WHEN dt > 0 AND dt <= 7200 THEN {_HAV.format('la', 'lo', 'lat', 'lon')} * 3600 / dt END AS v FROM l)
SELECT event_type, count(v) FILTER (v BETWEEN 0 AND 200) AS n, round(avg(v) FILTER (v BETWEEN 0 AND 200), 6) AS speed FROM s GROUP BY ALL"""


def _distance(spark, d):
    return se.distance_speed(signal(spark, d).withColumn("km", F.col("value") / 10), BY, "t", "km", longest=7200.0)


def distance_speed(spark, d):
    return _distance(spark, d).groupBy("event_type").agg(F.count("speed").alias("n"), r6(F.avg("speed")).alias("speed"))


DIST = f"""{SIG}, dl AS (SELECT *, t - lag(t) OVER w AS dt, value / 10 - lag(value / 10) OVER w AS dk FROM sig WINDOW w AS (PARTITION BY user_id, session_no ORDER BY t)),
ds AS (SELECT *, CASE WHEN dt > 0 AND dt <= 7200 AND dk >= 0 AND dk * 3600 / nullif(dt, 0) BETWEEN 0 AND 200 THEN dk * 3600 / nullif(dt, 0) END AS v FROM dl)"""
DISTANCE_SPEED = f"WITH {DIST} SELECT event_type, count(v) AS n, round(avg(v), 6) AS speed FROM ds GROUP BY ALL"


def speed_source(spark, d):
    direct = F.when(F.col("event_id") % 50 == 0, F.col("value"))
    s = se.chosen_speed(_distance(spark, d).withColumnRenamed("speed", "derived").withColumn("direct", direct), BY, "direct", "derived")
    return s.groupBy("speed_source").agg(F.count("speed").alias("n"), r6(F.avg("speed")).alias("speed"))


SPEED_SOURCE = f"""WITH {DIST}, x AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN value END AS direct FROM ds),
c AS (SELECT *, CASE WHEN bool_or(coalesce(direct BETWEEN 0 AND 200, FALSE)) OVER (PARTITION BY user_id, session_no) THEN 'direct' ELSE 'derived' END AS speed_source FROM x)
SELECT speed_source, count(CASE WHEN speed_source = 'direct' THEN direct ELSE v END) AS n, round(avg(CASE WHEN speed_source = 'direct' THEN direct ELSE v END), 6) AS speed FROM c GROUP BY ALL"""


def _origins(spark, d):
    return og.origins(signal(spark, d), BY, "t", "value", "event_id", P)


def origins(spark, d):
    return rounded(_origins(spark, d).where("reason is null").select(
        *BY, "origin", "raw_points", F.col("bins").cast("long").alias("bins"), "max_gap", "input_last", "evaluation",
        *[f"target_{i}" for i in (1, 2, 3)], *[f"span_{i}" for i in (1, 2, 3)]), "max_gap", "input_last", *[f"target_{i}" for i in (1, 2, 3)], *[f"span_{i}" for i in (1, 2, 3)])


def _target(i: int, h: float) -> str:
    return f"""b{i} AS (SELECT user_id, session_no, origin, max(t) FILTER (t <= origin + {h}) AS t0, min(t) FILTER (t >= origin + {h}) AS t1,
  arg_max(value, t) FILTER (t <= origin + {h}) AS v0, arg_min(value, t) FILTER (t >= origin + {h}) AS v1 FROM cand JOIN vs USING (user_id, session_no) GROUP BY ALL),
t{i} AS (SELECT user_id, session_no, origin, CASE WHEN t0 = origin + {h} THEN v0 WHEN t1 - t0 > 0 AND t1 - t0 <= {P.max_span} AND v0 + (v1 - v0) * (origin + {h} - t0) / (t1 - t0) BETWEEN {P.low} AND {P.high}
  THEN v0 + (v1 - v0) * (origin + {h} - t0) / (t1 - t0) END AS target_{i}, CASE WHEN t0 = origin + {h} THEN 0 ELSE t1 - t0 END AS sp{i} FROM b{i})"""


ORG = f"""{SIG}, vs AS (SELECT user_id, session_no, t, value FROM sig WHERE value BETWEEN {P.low} AND {P.high}),
st AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, session_no ORDER BY event_id) AS d FROM sig),
ss AS (SELECT user_id, session_no, count(*) AS points, min(coalesce(d, 1)) AS least_step, count(*) FILTER (value BETWEEN {P.low} AND {P.high}) AS valid,
  ceil((min(t) + {P.context}) / {P.stride}) * {P.stride} AS fo, max(t) - {max(P.horizons)} AS lo FROM st GROUP BY ALL),
sr AS (SELECT *, CASE WHEN points < 2 THEN 'invalid_or_unaligned_arrays' WHEN least_step <= 0 THEN 'non_monotonic_timestamps' WHEN valid < 2 THEN 'insufficient_valid_hr'
  WHEN fo > lo THEN 'session_too_short_after_alignment' END AS reason FROM ss),
cand AS (SELECT user_id, session_no, unnest(range(fo::BIGINT, floor(lo)::BIGINT + 1, {int(P.stride)}))::DOUBLE AS origin FROM sr WHERE reason IS NULL),
cp AS (SELECT cand.*, t, t - lag(t) OVER (PARTITION BY user_id, session_no, origin ORDER BY t) AS d FROM cand JOIN vs USING (user_id, session_no) WHERE t BETWEEN origin - {P.context} AND origin),
cx AS (SELECT user_id, session_no, origin, count(*) AS raw_points, count(DISTINCT CASE WHEN t > origin - {P.context} THEN ceil((t - (origin - {P.context})) / {P.grid}) END) AS bins,
  greatest(min(t) - (origin - {P.context}), origin - max(t), coalesce(max(d), 0)) AS max_gap, max(t) AS input_last FROM cp GROUP BY user_id, session_no, origin),
{", ".join(_target(i, h_) for i, h_ in enumerate(P.horizons, 1))},
orow AS (SELECT cand.*, raw_points, bins, max_gap, input_last, target_1, target_2, target_3,
  CASE WHEN target_1 IS NOT NULL THEN sp1 END AS span_1, CASE WHEN target_2 IS NOT NULL THEN sp2 END AS span_2, CASE WHEN target_3 IS NOT NULL THEN sp3 END AS span_3,
  CASE WHEN raw_points IS NULL THEN 'empty_context' WHEN bins / {P.bins} < {P.coverage}::DOUBLE THEN 'context_bin_coverage' WHEN max_gap > {P.max_gap} THEN 'context_gap'
    WHEN target_1 IS NULL THEN 'target_1_unavailable' WHEN target_2 IS NULL THEN 'target_2_unavailable' WHEN target_3 IS NULL THEN 'target_3_unavailable' END AS reason
  FROM cand LEFT JOIN cx USING (user_id, session_no, origin) LEFT JOIN t1 USING (user_id, session_no, origin) LEFT JOIN t2 USING (user_id, session_no, origin) LEFT JOIN t3 USING (user_id, session_no, origin))"""
ORIGINS = f"""WITH {ORG} SELECT user_id, session_no, origin, raw_points, bins, round(max_gap, 6) AS max_gap, round(input_last, 6) AS input_last, origin % {P.evaluation_stride} = 0 AS evaluation,
  round(target_1, 6) AS target_1, round(target_2, 6) AS target_2, round(target_3, 6) AS target_3, round(span_1, 6) AS span_1, round(span_2, 6) AS span_2, round(span_3, 6) AS span_3
FROM orow WHERE reason IS NULL"""


def origin_rejections(spark, d):
    whole = og.session_reasons(signal(spark, d), BY, "t", "value", "event_id", P)
    return og.rejections(whole, _origins(spark, d))


ORIGIN_REJECTIONS = f"""WITH {ORG}, r AS (SELECT reason FROM sr WHERE reason IS NOT NULL UNION ALL SELECT coalesce(reason, 'accepted') FROM orow) SELECT reason, count(*) AS n FROM r GROUP BY ALL"""


def origin_counts(spark, d):
    o = _origins(spark, d).where("reason is null")
    return o.groupBy("evaluation").agg(F.count("*").alias("origins"), F.countDistinct("user_id").alias("users"), r6(F.avg("coverage")).alias("coverage"))


ORIGIN_COUNTS = f"""WITH {ORG} SELECT origin % {P.evaluation_stride} = 0 AS evaluation, count(*) AS origins, count(DISTINCT user_id) AS users, round(avg(bins / {P.bins}), 6) AS coverage
FROM orow WHERE reason IS NULL GROUP BY ALL"""


def horizon_cohorts(spark, d):
    return og.cohorts(_origins(spark, d), P)


HORIZON_COHORTS = f"""WITH {ORG}, g AS (SELECT * FROM orow WHERE reason IS NULL OR reason LIKE 'target_%'),
l AS (SELECT target_1 IS NOT NULL AND target_2 IS NOT NULL AND target_3 IS NOT NULL AS every, unnest([1, 2, 3]) AS horizon, unnest([target_1, target_2, target_3]) AS target FROM g)
SELECT horizon, count(*) FILTER (every) AS common, count(target) AS with_target, count(*) FILTER (NOT every AND target IS NOT NULL) AS added FROM l GROUP BY ALL"""


def audit_origins(spark, d):
    from ..operators.audit import failures

    o = _origins(spark, d).where("reason is null")
    return failures(o, aligned=F.col("origin") % P.stride == 0, past_only=F.col("input_last") <= F.col("origin"), coverage=F.col("coverage") >= P.coverage,
                    gap=F.col("max_gap") <= P.max_gap, targets=F.col("target_1").isNotNull() & F.col("target_2").isNotNull() & F.col("target_3").isNotNull(),
                    span=F.greatest("span_1", "span_2", "span_3") <= P.max_span)


AUDIT_ORIGINS = f"""WITH {ORG} SELECT count(*) FILTER (origin % {P.stride} <> 0) AS aligned, count(*) FILTER (input_last > origin) AS past_only, count(*) FILTER (bins / {P.bins} < {P.coverage}::DOUBLE) AS coverage, count(*) FILTER (max_gap > {P.max_gap}) AS gap,
  count(*) FILTER (target_1 IS NULL OR target_2 IS NULL OR target_3 IS NULL) AS targets, count(*) FILTER (greatest(span_1, span_2, span_3) > {P.max_span}) AS span, count(*) AS checked
FROM orow WHERE reason IS NULL"""


def _contexts(spark, d):
    o = _origins(spark, d).where("reason is null").select(*BY, "origin")
    return og.contexts(_bins(spark, d), o, BY, P)


CTX = f"""{ORG}, bn AS (SELECT user_id, session_no, ceil(t / {P.grid})::BIGINT AS bin, arg_max(value, struct_pack(t := t, e := event_id)) AS value FROM sig WHERE value BETWEEN {P.low} AND {P.high} GROUP BY ALL),
acc AS (SELECT user_id, session_no, origin, target_1, target_2, target_3 FROM orow WHERE reason IS NULL),
ctx AS (SELECT acc.user_id, acc.session_no, origin, ({P.bins - 1} - (ceil(origin / {P.grid}) - bin))::INT AS pos, value FROM acc JOIN bn ON acc.user_id = bn.user_id AND acc.session_no = bn.session_no
  AND bin BETWEEN ceil(origin / {P.grid}) - {P.bins - 1} AND ceil(origin / {P.grid}))"""


def context_features(spark, d):
    return _contexts(spark, d).select(*BY, "origin", "pos", "value")


CONTEXT_FEATURES = f"WITH {CTX} SELECT * FROM ctx"


def channel_features(spark, d):
    f = og.channel_features(_contexts(spark, d), BY, P, (2, 3))
    return rounded(f, "last", "mean", "sd", "low", "high", "recent_2", "recent_3", "change", "slope", "coverage")


_X = f"((pos - {P.bins - 1}) * {P.grid})"
TABULAR = f"""WITH {CTX}, g AS (SELECT user_id, session_no, origin, arg_max(value, pos) AS last, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS low, max(value) AS high, arg_min(value, pos) AS f,
  count(*) AS n, sum({_X}) AS sx, sum(value) AS sy, sum({_X} * {_X}) AS sxx, sum({_X} * value) AS sxy, coalesce(avg(value) FILTER (pos >= {P.bins - 2}), 0) AS r2, coalesce(avg(value) FILTER (pos >= {P.bins - 3}), 0) AS r3 FROM ctx GROUP BY ALL)
SELECT user_id, session_no, origin, round(last, 6) AS last, round(mean, 6) AS mean, round(sd, 6) AS sd, round(low, 6) AS low, round(high, 6) AS high, round(r2, 6) AS recent_2, round(r3, 6) AS recent_3,
  round(last - f, 6) AS change, round(CASE WHEN abs(n * sxx - sx * sx) > 1e-8 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0 END, 6) AS slope, round(n / {P.bins}, 6) AS coverage FROM g"""


def naive_forecast(spark, d):
    return rounded(og.forecasts(_contexts(spark, d), BY, P, 0.25), "persistence", "ewma", "trend")


FCT = f"""{CTX}, fg AS (SELECT user_id, session_no, origin, list(value ORDER BY pos) AS vs_, arg_max(value, pos) AS persistence, count(*) AS n, sum({_X}) AS sx, sum(value) AS sy, sum({_X} * {_X}) AS sxx,
  sum({_X} * value) AS sxy FROM ctx GROUP BY ALL),
fh AS (SELECT *, unnest({[float(x) for x in P.horizons]}::DOUBLE[]) AS horizon FROM fg),
fc AS (SELECT user_id, session_no, origin, horizon, persistence, vs_, CASE WHEN n < 2 OR n * sxx - sx * sx = 0 THEN persistence
  ELSE greatest({P.low}, least({P.high}, sy / n + (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) * (horizon - sx / n))) END AS trend FROM fh)"""


def _ew(alpha: str) -> str:
    return f"greatest({P.low}, least({P.high}, list_reduce(vs_, lambda acc, x: {alpha}::DOUBLE * x + (1 - {alpha}::DOUBLE) * acc)))"


NAIVE_FORECAST = f"""WITH {FCT} SELECT user_id, session_no, origin, horizon, round(persistence, 6) AS persistence, round({_ew('0.25')}, 6) AS ewma, round(trend, 6) AS trend FROM fc"""


def _long_targets(spark, d):
    o = _origins(spark, d).where("reason is null")
    pairs = ", ".join(f"{h_}D, target_{i}" for i, h_ in enumerate(P.horizons, 1))
    return o.selectExpr(*BY, "origin", f"stack(3, {pairs}) as (horizon, target)")


def naive_eval(spark, d):
    f = og.forecasts(_contexts(spark, d), BY, P, 0.25).join(_long_targets(spark, d), [*BY, "origin", "horizon"])
    long = f.unpivot([*BY, "origin", "horizon", "target"], ["persistence", "ewma", "trend"], "model", "prediction")
    ev = long.withColumn("user_key", F.col("user_id")).withColumn("session_key", F.struct("user_id", "session_no"))
    return rounded(h.point_metrics(ev, ["model", "horizon"]), "mae", "rmse", "bias")


EVAL = f"""tl AS (SELECT user_id, session_no, origin, unnest({[float(x) for x in P.horizons]}::DOUBLE[]) AS horizon, unnest([target_1, target_2, target_3]) AS target FROM acc)"""
NAIVE_EVAL = f"""WITH {FCT}, {EVAL}, m AS (SELECT fc.user_id, fc.session_no, horizon, target, unnest(['persistence', 'ewma', 'trend']) AS model, unnest([persistence, {_ew('0.25')}, trend]) AS p
  FROM fc JOIN tl USING (user_id, session_no, origin, horizon)),
s AS (SELECT model, horizon, user_id, session_no, avg(abs(p - target)) AS a, sqrt(avg((p - target) * (p - target))) AS r, avg(p - target) AS b, count(*) AS n FROM m GROUP BY ALL),
u AS (SELECT model, horizon, user_id, avg(a) AS a, avg(r) AS r, avg(b) AS b, count(*) AS s, sum(n) AS n FROM s GROUP BY ALL)
SELECT model, horizon, round(avg(a), 6) AS mae, round(avg(r), 6) AS rmse, round(avg(b), 6) AS bias, count(*) AS users, sum(s)::BIGINT AS sessions, sum(n)::BIGINT AS origins FROM u GROUP BY ALL"""

ALPHAS = [0.1, 0.2, 0.3, 0.5, 0.8]


def ewma_tune(spark, d):
    """The smoothing with the least mean of the three horizons' errors; ties go to the smaller one."""
    c = _contexts(spark, d).groupBy(*BY, "origin").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("pairs"))
    values = F.transform("pairs", lambda p: p["value"])
    c = c.withColumn("v", values).select(*BY, "origin", F.explode(F.array(*[
        F.struct(F.lit(a).alias("alpha"), og.ewma(F.col("v"), a, P.low, P.high).alias("prediction")) for a in ALPHAS])).alias("x")).select(*BY, "origin", "x.*")
    f = c.join(_long_targets(spark, d), [*BY, "origin"]).withColumn("user_key", F.col("user_id")).withColumn("session_key", F.struct("user_id", "session_no"))
    m = h.nested_mean(f, ["alpha", "horizon"], mae=F.abs(F.col("prediction") - F.col("target")))
    score = m.groupBy("alpha").agg(r6(F.avg("mae")).alias("score"))
    return score.agg(F.min(F.struct("score", "alpha")).alias("b")).select("b.alpha", "b.score")


EWMA_TUNE = f"""WITH {FCT}, {EVAL}, one AS (SELECT DISTINCT user_id, session_no, origin, vs_ FROM fc),
m AS (SELECT one.user_id, one.session_no, origin, unnest({ALPHAS}::DOUBLE[]) AS alpha, unnest([{", ".join(_ew(str(a)) for a in ALPHAS)}]) AS p FROM one),
s AS (SELECT alpha, horizon, m.user_id, m.session_no, avg(abs(p - target)) AS e FROM m JOIN tl USING (user_id, session_no, origin) GROUP BY ALL),
u AS (SELECT alpha, horizon, user_id, avg(e) AS e FROM s GROUP BY ALL), g AS (SELECT alpha, horizon, avg(e) AS e FROM u GROUP BY ALL),
sc AS (SELECT alpha, round(avg(e), 6) AS score FROM g GROUP BY ALL) SELECT alpha, score FROM sc ORDER BY score, alpha LIMIT 1"""


def dense_vs_sparse(spark, d):
    o = _origins(spark, d).where("reason is null").withColumn("user_key", F.col("user_id")).withColumn("session_key", F.struct("user_id", "session_no"))
    dense = h.nested_mean(o, [], target=F.col("target_1")).withColumn("grid", F.lit("dense"))
    sparse = h.nested_mean(o.where("evaluation"), [], target=F.col("target_1")).withColumn("grid", F.lit("sparse"))
    return rounded(dense.unionByName(sparse), "target")


_NEST = "(SELECT '{0}' AS grid, round(avg(t), 6) AS target, count(*) AS users, sum(s)::BIGINT AS sessions, sum(n)::BIGINT AS origins FROM (SELECT user_id, avg(t) AS t, count(*) AS s, sum(n) AS n FROM (SELECT user_id, session_no, avg(target_1) AS t, count(*) AS n FROM acc WHERE {1} GROUP BY ALL) GROUP BY ALL))"
DENSE = f"WITH {CTX} SELECT * FROM {_NEST.format('dense', 'TRUE')} UNION ALL SELECT * FROM {_NEST.format('sparse', f'origin % {P.evaluation_stride} = 0')}"


PLANS = {
    "valid_range": (valid_range, VALID_RANGE), "gap_stats": (gap_stats, GAP_STATS), "quality_manifest": (quality_manifest, QUALITY_MANIFEST),
    "last_in_bin": (last_in_bin, LAST_IN_BIN), "grid_bins": (grid_bins, GRID_BINS), "session_summary": (session_summary, SESSION_SUMMARY),
    "asof_interpolate": (asof_interpolate, ASOF), "haversine": (haversine, HAVERSINE), "gps_speed": (gps_speed, GPS_SPEED),
    "distance_speed": (distance_speed, DISTANCE_SPEED), "speed_source": (speed_source, SPEED_SOURCE), "origins": (origins, ORIGINS),
    "origin_rejections": (origin_rejections, ORIGIN_REJECTIONS), "origin_counts": (origin_counts, ORIGIN_COUNTS), "horizon_cohorts": (horizon_cohorts, HORIZON_COHORTS),
    "audit_origins": (audit_origins, AUDIT_ORIGINS), "context_features": (context_features, CONTEXT_FEATURES), "channel_features": (channel_features, TABULAR),
    "naive_forecast": (naive_forecast, NAIVE_FORECAST), "naive_eval": (naive_eval, NAIVE_EVAL), "ewma_tune": (ewma_tune, EWMA_TUNE), "dense_vs_sparse": (dense_vs_sparse, DENSE),
}
