"""Hierarchical metrics, weights, summaries, intervals and inference over customers, orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, hierarchy as h, inference, intervals as iv
from .base import EV, evaluation, r6, rounded, table

def err():
    return F.abs(F.col("prediction") - F.col("target"))


def hier_point(spark, d):
    return rounded(h.point_metrics(evaluation(spark, d), ["regime", "horizon"]), "mae", "rmse", "bias")


HIER_POINT = f"""WITH {EV}, s AS (
  SELECT regime, horizon, user_key, session_key, avg(abs(prediction - target)) AS mae,
    sqrt(avg((prediction - target) * (prediction - target))) AS rmse, avg(prediction - target) AS bias, count(*) AS n
  FROM ev GROUP BY ALL),
u AS (SELECT regime, horizon, user_key, avg(mae) AS mae, avg(rmse) AS rmse, avg(bias) AS bias, count(*) AS s, sum(n) AS n FROM s GROUP BY ALL)
SELECT regime, horizon, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(bias), 6) AS bias,
  count(*) AS users, sum(s)::BIGINT AS sessions, sum(n)::BIGINT AS origins FROM u GROUP BY ALL"""


def hier_mean(spark, d):
    return rounded(h.nested_mean(evaluation(spark, d), ["regime"], error=err(), quantity=F.col("l_quantity")), "error", "quantity")


HIER_MEAN = f"""WITH {EV}, s AS (SELECT regime, user_key, session_key, avg(abs(prediction - target)) AS e, avg(l_quantity) AS q, count(*) AS n FROM ev GROUP BY ALL),
u AS (SELECT regime, user_key, avg(e) AS e, avg(q) AS q, count(*) AS s, sum(n) AS n FROM s GROUP BY ALL)
SELECT regime, round(avg(e), 6) AS error, round(avg(q), 6) AS quantity, count(*) AS users, sum(s)::BIGINT AS sessions, sum(n)::BIGINT AS origins FROM u GROUP BY ALL"""


def hier_weights(spark, d):
    w = h.origin_weights(evaluation(spark, d), [])
    return w.select("user_key", "session_key", "n_origins", r6(F.col("weight") * 1e6).alias("weight_ppm"))


HIER_WEIGHTS = f"""WITH {EV}, s AS (SELECT user_key, session_key, count(*) AS n_origins FROM ev GROUP BY ALL),
u AS (SELECT user_key, count(*) AS ns FROM s GROUP BY ALL)
SELECT user_key, session_key, n_origins, round(1.0 / ((SELECT count(*) FROM u) * ns * n_origins)::DOUBLE * 1e6, 6) AS weight_ppm
FROM s JOIN u USING (user_key)"""


def train_weights(spark, d):
    return h.training_weights(evaluation(spark, d)).select("user_key", "session_key", "n_origins", r6("weight").alias("weight"))


TRAIN_WEIGHTS = f"""WITH {EV}, s AS (SELECT user_key, session_key, count(*) AS n_origins FROM ev GROUP BY ALL),
u AS (SELECT user_key, count(*) AS ns FROM s GROUP BY ALL),
w AS (SELECT s.*, 1.0 / (n_origins * ns)::DOUBLE AS raw FROM s JOIN u USING (user_key))
SELECT user_key, session_key, n_origins, round(raw / (SELECT sum(raw * n_origins) / sum(n_origins) FROM w), 6) AS weight FROM w"""


def support_counts(spark, d):
    ev = evaluation(spark, d)
    return ev.groupBy("regime").agg(
        F.countDistinct("user_key").alias("users"), F.countDistinct("session_key").alias("sessions"), F.count("*").alias("origins"))


SUPPORT_COUNTS = f"""WITH {EV} SELECT regime, count(DISTINCT user_key) AS users, count(DISTINCT session_key) AS sessions, count(*) AS origins FROM ev GROUP BY ALL"""


def support_flags(spark, d):
    u = evaluation(spark, d).groupBy("family", "l_linenumber").agg(F.countDistinct("user_key").alias("users"))
    return u.select("*", *audit.support_flags(F.col("users")))


SUPPORT_FLAGS = f"""WITH {EV}, u AS (SELECT family, l_linenumber, count(DISTINCT user_key) AS users FROM ev GROUP BY ALL)
SELECT *, users < 25 AS caution, users >= 50 AS supported, users >= 30 AS reportable, users >= 10 AS releasable FROM u"""


def quantile_summary(spark, d):
    return rounded(h.numeric_summary(evaluation(spark, d), ["regime"], "target"), "p10", "median", "p90")


QUANTILE_SUMMARY = f"""WITH {EV} SELECT regime, count(target) AS n, min(target) AS low, round(quantile_cont(target, 0.1), 6) AS p10,
  round(median(target), 6) AS median, round(quantile_cont(target, 0.9), 6) AS p90, max(target) AS high FROM ev GROUP BY ALL"""


def _seeds(spark, d):
    """Suppliers modulo 5 as seeds: a mean absolute error for each."""
    ev = evaluation(spark, d).withColumn("seed", F.col("l_suppkey") % 5)
    return h.nested_mean(ev, ["seed", "mode", "horizon"], mae=err())


SEEDS = f"""{EV}, se AS (SELECT l_suppkey % 5 AS seed, mode, horizon, user_key, session_key, avg(abs(prediction - target)) AS e FROM ev GROUP BY ALL),
us AS (SELECT seed, mode, horizon, user_key, avg(e) AS e FROM se GROUP BY ALL),
m AS (SELECT seed, mode, horizon, avg(e) AS mae FROM us GROUP BY ALL)"""


def seed_summary(spark, d):
    return rounded(h.seed_summary(_seeds(spark, d), ["mode", "horizon"], "seed", "mae"), "median", "low", "high")


SEED_SUMMARY = f"""WITH {SEEDS} SELECT mode, horizon, round(median(mae), 6) AS median, round(min(mae), 6) AS low, round(max(mae), 6) AS high,
  count(DISTINCT seed) AS n_seeds, string_agg(seed::VARCHAR, ';' ORDER BY seed) AS seeds FROM m GROUP BY ALL"""


def seed_pairs(spark, d):
    return rounded(audit.mode_pairs(_seeds(spark, d).select("seed", "horizon", "mode", "mae"), ["seed", "horizon"], "mode", "mae", "F", "O"), "F", "O", "delta")


SEED_PAIRS = f"""WITH {SEEDS} SELECT a.seed, a.horizon, round(a.mae, 6) AS "F", round(b.mae, 6) AS "O", round(a.mae - b.mae, 6) AS delta
FROM m a JOIN m b ON a.seed = b.seed AND a.horizon = b.horizon WHERE a.mode = 'F' AND b.mode = 'O'"""


def seed_user_mean(spark, d):
    ev = evaluation(spark, d).withColumn("seed", F.col("l_suppkey") % 5)
    users = h.user_means(ev, ["seed"], mae=err())
    return users.groupBy("user_key").agg(r6(F.avg("mae")).alias("mae"), F.count("*").alias("n_seeds"))


SEED_USER_MEAN = f"""WITH {EV}, se AS (SELECT l_suppkey % 5 AS seed, user_key, session_key, avg(abs(prediction - target)) AS e FROM ev GROUP BY ALL),
us AS (SELECT seed, user_key, avg(e) AS e FROM se GROUP BY ALL) SELECT user_key, round(avg(e), 6) AS mae, count(*) AS n_seeds FROM us GROUP BY ALL"""


def unpivot_metrics(spark, d):
    m = h.point_metrics(evaluation(spark, d), ["regime", "horizon"])
    return rounded(audit.long_metrics(m, ["regime", "horizon"], ["mae", "rmse", "bias"]), "value")


UNPIVOT_METRICS = f"""WITH p AS ({HIER_POINT}) SELECT regime, horizon, metric, value FROM (UNPIVOT (SELECT regime, horizon, mae, rmse, bias FROM p)
  ON mae, rmse, bias INTO NAME metric VALUE value)"""


def pivot_report(spark, d):
    m = h.point_metrics(evaluation(spark, d), ["regime", "horizon"])
    wide = m.groupBy("regime").pivot("horizon", [1, 2, 3]).agg(F.first("mae"))
    return wide.select("regime", *[r6(F.col(f"`{i}`")).alias(f"mae_{i}") for i in (1, 2, 3)])


PIVOT_REPORT = f"""WITH p AS ({HIER_POINT}) SELECT regime, max(mae) FILTER (horizon = 1) AS mae_1, max(mae) FILTER (horizon = 2) AS mae_2,
  max(mae) FILTER (horizon = 3) AS mae_3 FROM p GROUP BY ALL"""


def weighted_quantile(spark, d):
    ev = evaluation(spark, d).withColumn("error", F.round(err(), 2))
    w = ev.join(h.origin_weights(ev, []).select("session_key", "weight"), "session_key")
    return h.weighted_quantile_higher(w, ["regime"], "error", "weight", 0.9)


WQ = f"""{EV}, s AS (SELECT user_key, session_key, count(*) AS no FROM ev GROUP BY ALL), u AS (SELECT user_key, count(*) AS ns FROM s GROUP BY ALL),
w AS (SELECT s.session_key, 1.0 / ((SELECT count(*) FROM u) * ns * no)::DOUBLE AS weight FROM s JOIN u USING (user_key)),
e AS (SELECT regime, horizon, round(abs(prediction - target), 2) AS error, weight FROM ev JOIN w USING (session_key)),
v AS (SELECT regime, error, sum(weight) AS w FROM e GROUP BY ALL),
c AS (SELECT regime, error, sum(w) OVER (PARTITION BY regime ORDER BY error ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY regime) AS total FROM v)"""
WEIGHTED_QUANTILE = f"""WITH {WQ} SELECT regime, min(error) AS quantile FROM c WHERE cum >= 0.9 * total - 1e-12 * total GROUP BY regime"""


def balanced_threshold(spark, d):
    ev = evaluation(spark, d).withColumn("error", F.round(err(), 2) - 20000)
    w = ev.join(h.origin_weights(ev, []).select("session_key", "weight"), "session_key")
    return rounded(iv.balanced_threshold(w, ["regime"], "error", "weight", 0.5), "threshold")


BALANCED_THRESHOLD = f"""WITH {WQ} SELECT regime, round(greatest(0, min(error) - 20000), 6) AS threshold FROM c WHERE cum >= 0.5 * total - 1e-12 * total GROUP BY regime"""


def weighted_cdf(spark, d):
    ev = evaluation(spark, d).withColumn("error", F.round(err(), 2))
    w = ev.join(h.origin_weights(ev, []).select("session_key", "weight"), "session_key")
    return rounded(h.weighted_cdf(w, ["regime"], "error", "weight", [1000.0, 10000.0, 50000.0]), "share")


WEIGHTED_CDF = f"""WITH {WQ} SELECT regime, threshold, round(sum(CASE WHEN error <= threshold THEN weight ELSE 0 END) / sum(weight), 6) AS share
FROM e, (VALUES (1000.0::DOUBLE), (10000.0::DOUBLE), (50000.0::DOUBLE)) t(threshold) GROUP BY ALL"""


def spearman_user(spark, d):
    return rounded(h.mean_user_spearman(evaluation(spark, d), ["regime"], "l_quantity", "target"), "spearman")


SPEARMAN_USER = f"""WITH {EV}, r AS (SELECT regime, user_key,
  rank() OVER (PARTITION BY regime, user_key ORDER BY l_quantity) + (count(*) OVER (PARTITION BY regime, user_key, l_quantity) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY regime, user_key ORDER BY target) + (count(*) OVER (PARTITION BY regime, user_key, target) - 1) / 2.0::DOUBLE AS ry FROM ev),
u AS (SELECT regime, user_key, count(*) AS n, stddev_pop(rx) AS sx, stddev_pop(ry) AS sy, corr(rx, ry) AS rho FROM r GROUP BY ALL)
SELECT regime, round(avg(rho), 6) AS spearman, count(*) AS users FROM u WHERE n >= 3 AND sx > 0 AND sy > 0 GROUP BY ALL"""


def normalization(spark, d):
    z = h.normalization(evaluation(spark, d), F.col("regime") == "N", "target")
    return z.groupBy("regime").agg(r6(F.avg("z")).alias("z_mean"), r6(F.min("z")).alias("z_low"), r6(F.max("z")).alias("z_high"))


NORMALIZATION = f"""WITH {EV}, m AS (SELECT avg(target) AS mu, sqrt(greatest(var_pop(target), 1e-6)) AS sd FROM ev WHERE regime = 'N')
SELECT regime, round(avg((target - mu) / sd), 6) AS z_mean, round(min((target - mu) / sd), 6) AS z_low, round(max((target - mu) / sd), 6) AS z_high FROM ev, m GROUP BY ALL"""


def family_cube(spark, d):
    ev = evaluation(spark, d)
    cells = h.cell_means(ev, "family", err())
    return rounded(h.full_cube(cells, "family", ev.select("family").distinct()), "value")


CELLS = f"""{EV}, cs AS (SELECT user_key, family, session_key, avg(abs(prediction - target)) AS v FROM ev GROUP BY ALL),
cells AS (SELECT user_key, family, avg(v) AS value, count(*) AS sessions FROM cs GROUP BY ALL)"""
FAMILY_CUBE = f"""WITH {CELLS} SELECT u.user_key, f.family, round(value, 6) AS value, sessions FROM (SELECT DISTINCT user_key FROM cells) u
CROSS JOIN (SELECT DISTINCT family FROM ev) f LEFT JOIN cells c ON c.user_key = u.user_key AND c.family = f.family"""


def standardized_mix(spark, d):
    ev = evaluation(spark, d)
    mix = ev.where("regime = 'N'").groupBy("family").agg(F.countDistinct("session_key").cast("double").alias("share"))
    return rounded(h.standardized(h.cell_means(ev, "family", err()), "family", mix), "standardized", "macro")


STANDARDIZED_MIX = f"""WITH {CELLS}, m AS (SELECT family, avg(value) AS value FROM cells GROUP BY ALL),
mix AS (SELECT family, count(DISTINCT session_key)::DOUBLE AS share FROM ev WHERE regime = 'N' GROUP BY ALL)
SELECT round(sum(value * share) / sum(share), 6) AS standardized, round(avg(value), 6) AS macro, count(*) AS cells FROM m JOIN mix USING (family)"""


def sport_share(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("user_key"), "o_orderpriority")
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"))
    return rounded(h.shares(s, users, F.col("o_orderpriority").startswith("1")), "share")


SPORT_SHARE = """SELECT c_custkey AS user_key, round(coalesce(avg(CASE WHEN o_orderpriority LIKE '1%' THEN 1.0::DOUBLE WHEN o_orderkey IS NOT NULL THEN 0.0 END), 0), 6) AS share
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"""


def shift_sessions(spark, d):
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = table(spark, d, "orders").join(nation, "o_custkey", "left")
    return rounded(h.distribution(o, ["c_nationkey"], "o_totalprice"), "mean", "sd", "p05", "p25", "p50", "p75", "p95")


SHIFT_SESSIONS = """SELECT c_nationkey, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd,
  round(quantile_cont(o_totalprice, 0.05), 6) AS p05, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.5), 6) AS p50,
  round(quantile_cont(o_totalprice, 0.75), 6) AS p75, round(quantile_cont(o_totalprice, 0.95), 6) AS p95
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


def source_shift(spark, d):
    """Mean user value of each region against the first region: difference and ratio."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"))
    u = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("n_regionkey").agg(F.avg("v").alias("mean"), F.count("*").alias("users"))
    base = u.where("n_regionkey = 0").select(F.col("mean").alias("base"))
    return u.crossJoin(F.broadcast(base)).select(
        "n_regionkey", "users", r6("mean").alias("mean"), r6(F.col("mean") - F.col("base")).alias("difference"), r6(F.col("mean") / F.col("base")).alias("ratio"))


SOURCE_SHIFT = """WITH o AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
u AS (SELECT n_regionkey, avg(v) AS mean, count(*) AS users FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN o ON c_custkey = o_custkey GROUP BY ALL)
SELECT n_regionkey, users, round(mean, 6) AS mean, round(mean - base, 6) AS difference, round(mean / base, 6) AS ratio
FROM u, (SELECT mean AS base FROM u WHERE n_regionkey = 0)"""


def subgroup_dim(spark, d):
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"), F.col("c_mktsegment").alias("subgroup"))
    ev = evaluation(spark, d).join(seg, "user_key")
    out = h.nested_mean(ev, ["subgroup"], mae=err())
    return rounded(out, "mae").select("*", *audit.support_flags(F.col("users")))


SUBGROUP_DIM = f"""WITH {EV}, s AS (SELECT c_mktsegment AS subgroup, user_key, session_key, avg(abs(prediction - target)) AS e, count(*) AS n
  FROM ev JOIN customer ON c_custkey = user_key GROUP BY ALL),
u AS (SELECT subgroup, user_key, avg(e) AS e, count(*) AS s, sum(n) AS n FROM s GROUP BY ALL),
g AS (SELECT subgroup, round(avg(e), 6) AS mae, count(*) AS users, sum(s)::BIGINT AS sessions, sum(n)::BIGINT AS origins FROM u GROUP BY ALL)
SELECT *, users < 25 AS caution, users >= 50 AS supported, users >= 30 AS reportable, users >= 10 AS releasable FROM g"""

# ------------------------------------------------------------------ intervals


def conformal_radius(spark, d):
    return rounded(iv.split_conformal_radius(evaluation(spark, d), ["regime", "horizon"], F.round(F.col("prediction") - F.col("target"), 2), 0.9), "radius")


CONFORMAL_RADIUS = f"""WITH {EV}, r AS (SELECT regime, horizon, abs(round(prediction - target, 2)) AS a, count(*) OVER (PARTITION BY regime, horizon) AS n,
  row_number() OVER (PARTITION BY regime, horizon ORDER BY abs(round(prediction - target, 2))) AS rn FROM ev)
SELECT regime, horizon, round(a, 6) AS radius, n FROM r WHERE rn = least(n, greatest(1, ceil((n + 1) * 0.9::DOUBLE)))"""


def _bounds():
    return F.col("prediction") * 0.8, F.col("prediction") * 1.2


def cqr_threshold(spark, d):
    low, high = _bounds()
    return rounded(iv.cqr_threshold(evaluation(spark, d), ["regime", "horizon"], F.round(iv.cqr_score(low, high, F.col("target")), 2), 0.9), "threshold")


CQR_THRESHOLD = f"""WITH {EV}, r AS (SELECT regime, horizon, round(greatest(prediction * 0.8::DOUBLE - target, target - prediction * 1.2::DOUBLE), 2) AS s FROM ev),
k AS (SELECT *, count(*) OVER (PARTITION BY regime, horizon) AS n, row_number() OVER (PARTITION BY regime, horizon ORDER BY s) AS rn FROM r)
SELECT regime, horizon, round(greatest(0, s), 6) AS threshold, n FROM k WHERE rn = least(n, ceil((n + 1) * 0.9::DOUBLE) + 1)"""


def interval_metrics(spark, d):
    low, high = iv.bounds(*_bounds(), F.lit(1000.0), 0.0, 200000.0)
    ev = evaluation(spark, d).withColumn("low", low).withColumn("high", high)
    m = h.nested_mean(ev, ["horizon"], picp=iv.inside(F.col("low"), F.col("high"), F.col("target")), width=F.col("high") - F.col("low"),
                      normalised=(F.col("high") - F.col("low")) / F.greatest(F.col("target"), F.lit(1.0)))
    return rounded(m.withColumn("coverage_error", F.abs(F.col("picp") - 0.9)), "picp", "width", "normalised", "coverage_error")


INTERVAL_METRICS = f"""WITH {EV}, b AS (SELECT *, greatest(0.0, least(200000.0, prediction * 0.8::DOUBLE - 1000)) AS low, greatest(0.0, least(200000.0, prediction * 1.2::DOUBLE + 1000)) AS high FROM ev),
s AS (SELECT horizon, user_key, session_key, avg(CASE WHEN target BETWEEN low AND high THEN 1.0::DOUBLE ELSE 0.0 END) AS p, avg(high - low) AS w,
  avg((high - low) / greatest(target, 1.0)) AS nw, count(*) AS n FROM b GROUP BY ALL),
u AS (SELECT horizon, user_key, avg(p) AS p, avg(w) AS w, avg(nw) AS nw, count(*) AS s, sum(n) AS n FROM s GROUP BY ALL)
SELECT horizon, round(avg(p), 6) AS picp, round(avg(w), 6) AS width, round(avg(nw), 6) AS normalised, round(abs(avg(p) - 0.9::DOUBLE), 6) AS coverage_error,
  count(*) AS users, sum(s)::BIGINT AS sessions, sum(n)::BIGINT AS origins FROM u GROUP BY ALL"""


def wis(spark, d):
    p = F.col("prediction")
    score = iv.weighted_interval_score(p, F.col("target"), [(0.1, p * 0.5, p * 1.5), (0.5, p * 0.8, p * 1.2)])
    return rounded(h.nested_mean(evaluation(spark, d), ["horizon"], wis=score), "wis")


WIS = f"""WITH {EV}, x AS (SELECT *, (0.5 * abs(target - prediction)
  + 0.05 * ((prediction * 1.5 - prediction * 0.5) + 20 * greatest(prediction * 0.5 - target, 0) + 20 * greatest(target - prediction * 1.5, 0))
  + 0.25 * ((prediction * 1.2::DOUBLE - prediction * 0.8::DOUBLE) + 4 * greatest(prediction * 0.8::DOUBLE - target, 0) + 4 * greatest(target - prediction * 1.2::DOUBLE, 0))) / 2.5 AS v FROM ev),
s AS (SELECT horizon, user_key, session_key, avg(v) AS v, count(*) AS n FROM x GROUP BY ALL),
u AS (SELECT horizon, user_key, avg(v) AS v, count(*) AS s, sum(n) AS n FROM s GROUP BY ALL)
SELECT horizon, round(avg(v), 6) AS wis, count(*) AS users, sum(s)::BIGINT AS sessions, sum(n)::BIGINT AS origins FROM u GROUP BY ALL"""


LEVELS = [0.05, 0.25, 0.5, 0.75, 0.95]


def pinball(spark, d):
    loss = iv.pinball(F.col("target"), [(q, F.col("prediction") * (0.5 + q)) for q in LEVELS])
    return rounded(h.nested_mean(evaluation(spark, d), ["horizon"], pinball=loss), "pinball")


_PIN = " + ".join(f"greatest({q}::DOUBLE * (target - prediction * {0.5 + q!r}::DOUBLE), {q - 1!r}::DOUBLE * (target - prediction * {0.5 + q!r}::DOUBLE))" for q in LEVELS)
PINBALL = f"""WITH {EV}, x AS (SELECT *, ({_PIN}) / 5 AS v FROM ev),
s AS (SELECT horizon, user_key, session_key, avg(v) AS v, count(*) AS n FROM x GROUP BY ALL),
u AS (SELECT horizon, user_key, avg(v) AS v, count(*) AS s, sum(n) AS n FROM s GROUP BY ALL)
SELECT horizon, round(avg(v), 6) AS pinball, count(*) AS users, sum(s)::BIGINT AS sessions, sum(n)::BIGINT AS origins FROM u GROUP BY ALL"""


def quantile_sort(spark, d):
    q = F.array_sort(F.array(F.col("target"), F.col("prediction"), F.col("target") / 2))
    out = evaluation(spark, d).withColumn("q", q)
    return out.groupBy("regime").agg(r6(F.avg(F.element_at("q", 1))).alias("low"), r6(F.avg(F.element_at("q", 2))).alias("mid"), r6(F.avg(F.element_at("q", 3))).alias("high"))


QUANTILE_SORT = f"""WITH {EV}, x AS (SELECT regime, list_sort([target, prediction, target / 2]) AS q FROM ev)
SELECT regime, round(avg(q[1]), 6) AS low, round(avg(q[2]), 6) AS mid, round(avg(q[3]), 6) AS high FROM x GROUP BY ALL"""

# ------------------------------------------------------------------ inference


def _deltas(spark, d):
    users = h.user_means(evaluation(spark, d), ["mode", "horizon"], mae=err())
    return inference.paired(users.where("mode = 'F'"), users.where("mode = 'O'"), ["horizon", "user_key"], "mae")


DELTAS = f"""{EV}, ds AS (SELECT mode, horizon, user_key, session_key, avg(abs(prediction - target)) AS e FROM ev GROUP BY ALL),
du AS (SELECT mode, horizon, user_key, avg(e) AS e FROM ds GROUP BY ALL),
dl AS (SELECT a.horizon, a.user_key, a.e AS value_a, b.e AS value_b, a.e - b.e AS delta FROM du a JOIN du b ON a.horizon = b.horizon AND a.user_key = b.user_key
  WHERE a.mode = 'F' AND b.mode = 'O')"""


def paired_delta(spark, d):
    return rounded(_deltas(spark, d), "value_a", "value_b", "delta")


PAIRED_DELTA = f"WITH {DELTAS} SELECT horizon, user_key, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(delta, 6) AS delta FROM dl"


def wilcoxon(spark, d):
    deltas = _deltas(spark, d).withColumn("delta", F.round("delta", 2))
    return rounded(inference.wilcoxon(deltas, ["horizon"], "delta"), "z")


WILCOXON = f"""WITH {DELTAS}, x AS (SELECT horizon, round(delta, 2) AS delta FROM dl WHERE round(delta, 2) <> 0),
r AS (SELECT horizon, delta, rank() OVER (PARTITION BY horizon ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY horizon, abs(delta)) - 1) / 2.0::DOUBLE AS r FROM x),
t AS (SELECT horizon, sum((t * t * t - t)::DOUBLE) AS tie FROM (SELECT horizon, abs(delta) AS m, count(*) AS t FROM x GROUP BY ALL) GROUP BY ALL),
w AS (SELECT horizon, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0.0::DOUBLE END) AS w_plus, sum(CASE WHEN delta < 0 THEN r ELSE 0.0::DOUBLE END) AS w_minus FROM r GROUP BY ALL)
SELECT horizon, n, w_plus, w_minus, least(w_plus, w_minus) AS w,
  round((least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48), 6) AS z FROM w JOIN t USING (horizon)"""


def holm(spark, d):
    p = table(spark, d, "part").groupBy("p_brand", "p_size").agg((F.min("p_partkey") % 1000 / 20000.0).alias("p"))
    return rounded(inference.holm(p, ["p_brand"], "p", "p_size"), "p", "adjusted")


HOLM = """WITH x AS (SELECT p_brand, p_size, min(p_partkey) % 1000 / 20000.0::DOUBLE AS p FROM part GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_size) AS rn, count(*) OVER (PARTITION BY p_brand) AS m FROM x)
SELECT p_brand, p_size, round(p, 6) AS p, round(max(least(1.0, (m - rn + 1) * p)) OVER (PARTITION BY p_brand ORDER BY p, p_size ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM s"""


REPLICATES = 10_000


def draws(table_sql: str, user: str, salt: int = 0, replicates: int = REPLICATES) -> str:
    """Rows of a table for each replicate r with weight w, in SQL."""
    m = inference.DRAW_MODULUS
    return f"""(SELECT * EXCLUDE (z), {' + '.join(f'(z >= {int(q * m)})::INT' for q in inference.POISSON)} AS w FROM (SELECT * EXCLUDE (y), (y * y + {salt + 1}) % {m} AS z
  FROM (SELECT * EXCLUDE (y0), (y0 * 16807 + r) % {m} AS y FROM (SELECT * EXCLUDE (x0), (x0 * x0 + {user}::BIGINT) % {m} AS y0
  FROM (SELECT *, ({user}::BIGINT * 48271 + r * 69621 + {salt}) % {m} AS x0 FROM {table_sql}, range({replicates}) t(r))))))"""


def boot_mean_hash(spark, d):
    """Two metrics of each regime, drawn jointly."""
    users = h.user_means(evaluation(spark, d), ["regime"], mae=err(), quantity=F.col("l_quantity"))
    out = inference.poisson_bootstrap(users, ["regime"], ["mae", "quantity"], "user_key", REPLICATES)
    return rounded(out, *[n + e for n in ("mae", "quantity") for e in ("", "_low", "_high")], digits=4)


BU = f"""{EV}, bs AS (SELECT regime, user_key, session_key, avg(abs(prediction - target)) AS mae, avg(l_quantity) AS quantity FROM ev GROUP BY ALL),
bu AS (SELECT regime, user_key, avg(mae) AS mae, avg(quantity) AS quantity FROM bs GROUP BY ALL)"""
BOOT_MEAN_HASH = f"""WITH {BU}, m AS (SELECT regime, r, sum(w * mae) / sum(w) AS a, sum(w * quantity) / sum(w) AS b FROM {draws('bu', 'user_key')} GROUP BY ALL),
q AS (SELECT regime, quantile_cont(a, 0.025) AS al, quantile_cont(a, 0.975) AS ah, quantile_cont(b, 0.025) AS bl, quantile_cont(b, 0.975) AS bh FROM m GROUP BY ALL)
SELECT regime, count(*) AS users, round(avg(mae), 4) AS mae, round(any_value(al), 4) AS mae_low, round(any_value(ah), 4) AS mae_high, round(avg(quantity), 4) AS quantity,
  round(any_value(bl), 4) AS quantity_low, round(any_value(bh), 4) AS quantity_high FROM bu JOIN q USING (regime) GROUP BY regime"""


def boot_numpy(spark, d):
    users = h.user_means(evaluation(spark, d), ["regime"], mae=err(), quantity=F.col("l_quantity"))
    return inference.bootstrap(users, ["regime"], ["mae", "quantity"], "user_key")


PLANS = {
    "hier_point": (hier_point, HIER_POINT), "hier_mean": (hier_mean, HIER_MEAN), "hier_weights": (hier_weights, HIER_WEIGHTS),
    "train_weights": (train_weights, TRAIN_WEIGHTS), "support_counts": (support_counts, SUPPORT_COUNTS), "support_flags": (support_flags, SUPPORT_FLAGS),
    "quantile_summary": (quantile_summary, QUANTILE_SUMMARY), "seed_summary": (seed_summary, SEED_SUMMARY), "seed_pairs": (seed_pairs, SEED_PAIRS),
    "seed_user_mean": (seed_user_mean, SEED_USER_MEAN), "unpivot_metrics": (unpivot_metrics, UNPIVOT_METRICS), "pivot_report": (pivot_report, PIVOT_REPORT),
    "weighted_quantile": (weighted_quantile, WEIGHTED_QUANTILE), "balanced_threshold": (balanced_threshold, BALANCED_THRESHOLD),
    "weighted_cdf": (weighted_cdf, WEIGHTED_CDF), "spearman_user": (spearman_user, SPEARMAN_USER), "normalization": (normalization, NORMALIZATION),
    "family_cube": (family_cube, FAMILY_CUBE), "standardized_mix": (standardized_mix, STANDARDIZED_MIX), "sport_share": (sport_share, SPORT_SHARE),
    "shift_sessions": (shift_sessions, SHIFT_SESSIONS), "source_shift": (source_shift, SOURCE_SHIFT), "subgroup_dim": (subgroup_dim, SUBGROUP_DIM),
    "conformal_radius": (conformal_radius, CONFORMAL_RADIUS), "cqr_threshold": (cqr_threshold, CQR_THRESHOLD),
    "interval_metrics": (interval_metrics, INTERVAL_METRICS), "wis": (wis, WIS), "pinball": (pinball, PINBALL), "quantile_sort": (quantile_sort, QUANTILE_SORT),
    "paired_delta": (paired_delta, PAIRED_DELTA), "wilcoxon": (wilcoxon, WILCOXON), "holm": (holm, HOLM),
    "boot_mean_hash": (boot_mean_hash, BOOT_MEAN_HASH), "boot_numpy": (boot_numpy, None),
}
