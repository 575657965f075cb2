"""Splits, leakage control and causal history over customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import offset_seed, pseudonym, row_fraction, stable_fraction, stable_seed
from ..operators import history as hi, splits as sp
from .base import SESS, r6, rounded, sessions, table

_FRACTION = "concat('0x', substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"


def _fraction(payload: str) -> str:
    return _FRACTION.format(payload)


def stable_fraction_(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", stable_fraction("unseen_user", F.col("c_custkey")).alias("fraction"),
                    row_fraction("rows", F.col("c_nationkey"), F.col("c_custkey")).alias("by_row"))


STABLE_FRACTION = f"""SELECT c_custkey, {_fraction("'20260722|unseen_user|' || c_custkey")} AS fraction,
  {_fraction("'rows|' || c_nationkey || '|' || c_custkey")} AS by_row FROM customer"""


def stable_seed_(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", stable_seed(F.col("c_name")).alias("seed"), offset_seed(17, F.col("c_name")).alias("big"),
                    offset_seed(17, F.col("c_name"), little=True).alias("little"))


_H = "sha256(c_name)"
_LITTLE = f"concat('0x', substr({_H}, 7, 2), substr({_H}, 5, 2), substr({_H}, 3, 2), substr({_H}, 1, 2))::BIGINT"
STABLE_SEED = f"""SELECT c_custkey, {_LITTLE} AS seed, (17 + concat('0x', substr({_H}, 1, 8))::BIGINT) % 4294967296 AS big,
  (17 + {_LITTLE}) % 4294967296 AS little FROM customer"""


def pseudonyms(spark, d):
    return table(spark, d, "customer").select("c_custkey", pseudonym("cadenza", F.col("c_mktsegment"), F.col("c_custkey")).alias("alias"))


PSEUDONYM = """SELECT c_custkey, substr(sha256(encode('cadenza') || '\\x00'::BLOB || encode(c_mktsegment) || '\\x00'::BLOB || encode(c_custkey::VARCHAR)), 1, 20) AS alias FROM customer"""


def splits_user(spark, d):
    return sp.user_split(table(spark, d, "customer").select("c_custkey"), "c_custkey", "unseen_user").drop("fraction")


_USER = f"""SELECT c_custkey, CASE WHEN f < 0.70::DOUBLE THEN 'train' WHEN f < 0.80::DOUBLE THEN 'validation' WHEN f < 0.90::DOUBLE THEN 'calibration' ELSE 'test' END AS partition
FROM (SELECT c_custkey, {_fraction("'20260722|unseen_user|' || c_custkey")} AS f FROM customer)"""


def _temporal(spark, d):
    return sp.temporal_split(sessions(spark, d), "user_key", "start_day", "session_key")


def splits_temporal(spark, d):
    return _temporal(spark, d).select("user_key", "session_key", "n", "partition")


TEMPORAL = f"""{SESS}, o AS (SELECT *, count(*) OVER (PARTITION BY user_key) AS n, row_number() OVER (PARTITION BY user_key ORDER BY start_day, session_key) - 1 AS position FROM sess),
tp AS (SELECT *, CASE WHEN n < 10 THEN 'insufficient_user_history' WHEN position < floor(0.70::DOUBLE * n) THEN 'train'
  WHEN position < floor(0.80::DOUBLE * n) THEN 'validation' WHEN position < floor(0.90::DOUBLE * n) THEN 'calibration' ELSE 'test' END AS partition FROM o)"""
SPLITS_TEMPORAL = f"WITH {TEMPORAL} SELECT user_key, session_key, n, partition FROM tp"


def strict_temporal(spark, d):
    return sp.strict_temporal(_temporal(spark, d), "user_key", "start_day", "end_day").select("user_key", "session_key", "partition", "strict")


STRICT = f"""{TEMPORAL}, c AS (SELECT *, CASE partition WHEN 'train' THEN 1 WHEN 'validation' THEN 2 WHEN 'calibration' THEN 3 WHEN 'test' THEN 4 END AS code FROM tp),
x AS (SELECT a.session_key FROM c a JOIN c b ON a.user_key = b.user_key AND a.code < b.code AND b.start_day <= a.end_day
  UNION SELECT b.session_key FROM c a JOIN c b ON a.user_key = b.user_key AND a.code < b.code AND b.start_day <= a.end_day)"""
STRICT_TEMPORAL = f"""WITH {STRICT} SELECT user_key, session_key, partition, CASE WHEN session_key IN (SELECT session_key FROM x) THEN 'excluded' ELSE partition END AS strict FROM c"""


def splits_external(spark, d):
    return sp.external_split(sessions(spark, d), "user_key", "family", "secondary_adaptation")


SPLITS_EXTERNAL = f"""WITH {SESS}, p AS (SELECT DISTINCT user_key, family FROM sess),
f AS (SELECT *, {_fraction("'20260722|secondary_adaptation|' || family || '|' || user_key")} AS fr FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY fr, user_key) AS rn, count(*) OVER (PARTITION BY family) AS n FROM f)
SELECT user_key, bool_or(rn <= ceil(0.20::DOUBLE * n)) AS adaptation FROM r GROUP BY ALL"""


def overlap_matrix(spark, d):
    return sp.overlaps(_temporal(spark, d), "partition", "user_key")


OVERLAP_MATRIX = f"""WITH {TEMPORAL}, u AS (SELECT DISTINCT partition, user_key FROM tp)
SELECT a.partition AS "left", b.partition AS "right", count(*) AS shared FROM u a JOIN u b ON a.user_key = b.user_key AND a.partition <= b.partition GROUP BY ALL"""


def _held(spark, d):
    s = sessions(spark, d)
    users = sp.user_split(s.select("user_key").distinct(), "user_key", "unseen_user").select("user_key", F.col("partition").alias("user_part"))
    return sp.held_out_family(s.join(users, "user_key"), "user_key", "family", "5-LOW", "user_part")


def sport_holdout(spark, d):
    return _held(spark, d).groupBy("role").agg(F.count("*").alias("sessions"), F.countDistinct("user_key").alias("users"))


_UP = f"""up AS (SELECT user_key, CASE WHEN f < 0.70::DOUBLE THEN 'train' WHEN f < 0.80::DOUBLE THEN 'validation' WHEN f < 0.90::DOUBLE THEN 'calibration' ELSE 'test' END AS user_part
  FROM (SELECT DISTINCT user_key, {_fraction("'20260722|unseen_user|' || user_key")} AS f FROM sess))"""
SPORT_HOLDOUT = f"""WITH {SESS}, {_UP}, r AS (SELECT sess.*, CASE WHEN family <> '5-LOW' AND user_part <> 'test' THEN user_part WHEN family = '5-LOW' AND user_part = 'train' THEN 'same_user'
  WHEN family = '5-LOW' AND user_part = 'test' THEN 'joint' ELSE 'unused' END AS role FROM sess JOIN up USING (user_key))
SELECT role, count(*) AS sessions, count(DISTINCT user_key) AS users FROM r GROUP BY ALL"""


def shift_candidates(spark, d):
    return sp.shift_candidates(sessions(spark, d), "family", "user_key", 1000, 50)


SHIFT_CANDIDATES = f"WITH {SESS} SELECT family, count(*) AS sessions, count(DISTINCT user_key) AS users, count(*) >= 1000 AND count(DISTINCT user_key) >= 50 AS candidate FROM sess GROUP BY ALL"


def leak_partition(spark, d):
    out = _leaky(spark, d)
    return out.groupBy("partition", "leak_partition", "contamination").agg(F.count("*").alias("rows"), F.countDistinct("session_key").alias("sessions"))


def _leaky(spark, d):
    """Lines as origins of the sessions of the temporal split; every fourth line number is evaluated."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_key"), "l_linenumber", "l_suppkey").distinct()
    rows = lines.join(_temporal(spark, d).select("session_key", "user_key", "partition").where("partition <> 'insufficient_user_history'"), "session_key")
    return sp.contaminated_rows(rows, "leak", "session_key", "l_suppkey", "partition", F.col("l_linenumber") % 4 == 1)


LEAKY = f"""{TEMPORAL}, ll AS (SELECT DISTINCT l_orderkey AS session_key, l_linenumber, l_suppkey FROM lineitem),
lr AS (SELECT ll.*, user_key, partition, l_linenumber % 4 = 1 AS ev FROM ll JOIN tp USING (session_key) WHERE partition <> 'insufficient_user_history'),
ts AS (SELECT DISTINCT session_key FROM lr WHERE partition = 'test' AND ev),
lf AS (SELECT *, {_fraction("'leak|' || session_key || '|' || l_suppkey")} AS f, session_key IN (SELECT session_key FROM ts) AS tested FROM lr),
lk AS (SELECT *, CASE WHEN partition = 'test' AND ev THEN 'test' WHEN partition = 'test' AND tested THEN CASE WHEN f < 0.70::DOUBLE / 0.90::DOUBLE THEN 'train'
    WHEN f < 0.80::DOUBLE / 0.90::DOUBLE THEN 'validation' ELSE 'calibration' END WHEN partition = 'train' THEN 'train' WHEN partition IN ('validation', 'calibration') AND ev THEN partition END AS leak_partition,
  partition = 'test' AND NOT ev AND tested AS contamination FROM lf)"""
LEAK_PARTITION = f"WITH {LEAKY} SELECT partition, leak_partition, contamination, count(*) AS rows, count(DISTINCT session_key) AS sessions FROM lk GROUP BY ALL"


def leak_proximity(spark, d):
    s = _temporal(spark, d)
    near = sp.nearest_distance(s.where("partition = 'test'").select("user_key", "session_key", "start_day"),
                               s.where("partition = 'train'").select("user_key", "start_day"), ["user_key"], "start_day", 120)
    return near.select("user_key", "session_key", "distance", F.greatest(F.lit(0), 300 - F.col("distance")).alias("overlap"))


LEAK_PROXIMITY = f"""WITH {TEMPORAL}, n AS (SELECT a.user_key, a.session_key, min(abs(a.start_day - b.start_day)) AS m FROM tp a LEFT JOIN tp b ON a.user_key = b.user_key AND b.partition = 'train'
  WHERE a.partition = 'test' GROUP BY ALL)
SELECT user_key, session_key, CASE WHEN m <= 120 THEN m END AS distance, CASE WHEN m <= 120 THEN greatest(0, 300 - m) ELSE 0 END AS overlap FROM n"""


def align_semi(spark, d):
    """Matched comparison rows: sessions of the temporal test that also belong to the joint role."""
    test = _temporal(spark, d).where("partition = 'test'").select("session_key")
    joint = _held(spark, d).where("role = 'joint'").select("session_key")
    return test.agg(F.count("*").alias("wanted")).crossJoin(test.join(joint, "session_key", "left_semi").agg(F.count("*").alias("shared"))).crossJoin(
        test.join(joint, "session_key", "left_anti").agg(F.count("*").alias("missing")))


ALIGN_SEMI = f"""WITH {TEMPORAL}, {_UP}, j AS (SELECT session_key FROM sess JOIN up USING (user_key) WHERE family = '5-LOW' AND user_part = 'test'),
t AS (SELECT session_key FROM tp WHERE partition = 'test')
SELECT (SELECT count(*) FROM t) AS wanted, (SELECT count(*) FROM t SEMI JOIN j USING (session_key)) AS shared, (SELECT count(*) FROM t ANTI JOIN j USING (session_key)) AS missing"""


def matched_availability(spark, d):
    """Held-out error less full error per user, where the discount plays the part of the error."""
    from ..operators.hierarchy import user_means
    from .base import evaluation

    ev = evaluation(spark, d)
    users = user_means(ev.where("family = '5-LOW'"), [], held=F.col("l_discount") * 100, full=F.col("l_tax") * 100)
    return users.agg(F.count("*").alias("users"), r6(F.avg(F.col("held") - F.col("full"))).alias("delta"),
                     r6(100 * F.avg((F.col("held") > F.col("full")).cast("double"))).alias("worse_percent"),
                     r6(F.avg(100 * (F.col("held") - F.col("full")) / F.nullif(F.col("held"), F.lit(0.0)))).alias("optimism"))


MATCHED = """WITH s AS (SELECT o_custkey AS u, o_orderkey AS k, avg(l_discount * 100) AS held, avg(l_tax * 100) AS "full" FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderpriority = '5-LOW' GROUP BY ALL), v AS (SELECT u, avg(held) AS held, avg("full") AS "full" FROM s GROUP BY ALL)
SELECT count(*) AS users, round(avg(held - "full"), 6) AS delta, round(100 * avg(CASE WHEN held > "full" THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS worse_percent,
  round(avg(100 * (held - "full") / nullif(held, 0)), 6) AS optimism FROM v"""


def _history(spark, d, **kw):
    s = sessions(spark, d).withColumns({"sd": F.col("price") / 100, "speed": F.col("price") % 50, "alt": F.col("price") % 7})
    return hi.causal_history(s, "user_key", "session_key", "family", "start_day", "end_day", "price", "sd", "speed", "alt", day=1.0, **kw)


def causal_history(spark, d):
    return rounded(_history(spark, d), *hi.FEATURES, digits=4)


def _history_sql(enters: str = "TRUE") -> str:
    return f"""{SESS}, h AS (SELECT *, price / 100 AS sd, price % 50 AS speed, price % 7 AS alt FROM sess),
j AS (SELECT c.user_key, c.session_key, c.start_day AS now, c.family AS cf, p.* EXCLUDE (user_key, session_key)
  FROM h c LEFT JOIN h p ON p.user_key = c.user_key AND p.end_day <= c.start_day AND p.start_day < c.start_day AND {enters}),
a AS (SELECT user_key, session_key, count(start_day) AS n, avg(end_day - start_day) AS d, stddev_pop(end_day - start_day) AS dsd, avg(price) AS v, stddev_pop(price) AS vsd,
  avg(sd) AS vs, avg(speed) AS s, stddev_pop(speed) AS ssd, avg(alt) AS al, count(start_day) FILTER (family = cf) AS sn, avg(price) FILTER (family = cf) AS sv,
  avg(speed) FILTER (family = cf) AS ssp, max(start_day) AS prev, any_value(now) AS now FROM j GROUP BY ALL)"""


CAUSAL_HISTORY = f"""WITH {_history_sql()} SELECT user_key, session_key, n AS prior_count, n > 0 AS mask,
  round(ln(1 + n), 4) AS log_count, round(ln(1 + coalesce(d, 0)), 4) AS log_duration_mean, round(ln(1 + coalesce(dsd, 0)), 4) AS log_duration_sd,
  round(coalesce(v, 0), 4) AS value_mean, round(coalesce(vsd, 0), 4) AS value_mean_sd, round(coalesce(vs, 0), 4) AS value_sd_mean, round(coalesce(s, 0), 4) AS speed_mean,
  round(coalesce(ssd, 0), 4) AS speed_mean_sd, round(coalesce(al, 0), 4) AS altitude_sd_mean, round(ln(1 + sn), 4) AS log_same_count, round(coalesce(sv, 0), 4) AS same_value_mean,
  round(coalesce(ssp, 0), 4) AS same_speed_mean, round(ln(1 + coalesce(now - prev, 0)), 4) AS log_days_since FROM a"""


def history_masked(spark, d):
    h = hi.masked(_history(spark, d), F.col("session_key") % 2 == 0)
    return h.groupBy("mask").agg(F.count("*").alias("n"), F.round(F.sum("value_mean"), 2).alias("total"))


HISTORY_MASKED = f"""WITH {_history_sql()} SELECT n > 0 AND session_key % 2 <> 0 AS mask, count(*) AS n,
  round(sum(CASE WHEN session_key % 2 = 0 THEN 0.0 ELSE coalesce(v, 0) END), 2) AS total FROM a GROUP BY 1"""


def history_buckets(spark, d):
    h = _history(spark, d).join(sessions(spark, d).select("session_key", "status"), "session_key")
    return hi.availability(h, "user_key", ["status"])


HISTORY_BUCKETS = f"""WITH {_history_sql()}, b AS (SELECT a.*, status FROM a JOIN sess USING (session_key)),
u AS (SELECT status, a.user_key, count(*) AS s, count(*) FILTER (n = 0) AS n0, count(*) FILTER (n BETWEEN 1 AND 4) AS n1, count(*) FILTER (n BETWEEN 5 AND 9) AS n5,
  count(*) FILTER (n >= 10) AS n10, bool_or(n > 0) AS x, bool_and(n > 0) AS y FROM b a GROUP BY ALL)
SELECT status, sum(s)::BIGINT AS sessions, sum(n0)::BIGINT AS "none", sum(n1)::BIGINT AS one_to_four, sum(n5)::BIGINT AS five_to_nine, sum(n10)::BIGINT AS ten_or_more,
  count(*) AS users, count(*) FILTER (x) AS users_any, count(*) FILTER (y) AS users_all FROM u GROUP BY ALL"""


def history_without_family(spark, d):
    h = _history(spark, d, counts=F.col("family") != "5-LOW")
    return h.groupBy("prior_count").agg(F.count("*").alias("sessions"))


HISTORY_WITHOUT = f"""WITH {_history_sql("p.family <> '5-LOW'")} SELECT n AS prior_count, count(*) AS sessions FROM a GROUP BY ALL"""


def regimes_explode(spark, d):
    s = _temporal(spark, d)
    users = sp.user_split(s.select("user_key").distinct(), "user_key", "unseen_user").select("user_key", F.col("partition").alias("user_part"))
    low = F.col("family").isin("5-LOW", "1-URGENT")
    regimes = F.array_compact(F.array(
        F.when(F.col("partition") == "test", "internal_temporal_test"), F.when(F.col("user_part") == "test", "unseen_user_test"),
        F.when(low, F.concat(F.lit("unseen_sport__"), F.col("family"))),
        F.when(low & (F.col("user_part") == "test"), F.concat(F.lit("joint_user_sport__"), F.col("family")))))
    return s.join(users, "user_key").select("user_key", "session_key", F.explode(regimes).alias("regime")).groupBy("regime").agg(
        F.count("*").alias("sessions"), F.countDistinct("user_key").alias("users"))


REGIMES = f"""WITH {TEMPORAL}, {_UP}, r AS (SELECT user_key, session_key, unnest([CASE WHEN partition = 'test' THEN 'internal_temporal_test' END, CASE WHEN user_part = 'test' THEN 'unseen_user_test' END,
  CASE WHEN family IN ('5-LOW', '1-URGENT') THEN 'unseen_sport__' || family END, CASE WHEN family IN ('5-LOW', '1-URGENT') AND user_part = 'test' THEN 'joint_user_sport__' || family END]) AS regime
  FROM tp JOIN up USING (user_key))
SELECT regime, count(*) AS sessions, count(DISTINCT user_key) AS users FROM r WHERE regime IS NOT NULL GROUP BY ALL"""


PLANS = {
    "stable_fraction": (stable_fraction_, STABLE_FRACTION), "stable_seed": (stable_seed_, STABLE_SEED), "pseudonym": (pseudonyms, PSEUDONYM),
    "splits_user": (splits_user, _USER), "splits_temporal": (splits_temporal, SPLITS_TEMPORAL), "strict_temporal": (strict_temporal, STRICT_TEMPORAL),
    "splits_external": (splits_external, SPLITS_EXTERNAL), "overlap_matrix": (overlap_matrix, OVERLAP_MATRIX), "sport_holdout": (sport_holdout, SPORT_HOLDOUT),
    "shift_candidates": (shift_candidates, SHIFT_CANDIDATES), "leak_partition": (leak_partition, LEAK_PARTITION), "leak_proximity": (leak_proximity, LEAK_PROXIMITY),
    "align_semi": (align_semi, ALIGN_SEMI), "matched_availability": (matched_availability, MATCHED), "causal_history": (causal_history, CAUSAL_HISTORY),
    "history_masked": (history_masked, HISTORY_MASKED), "history_buckets": (history_buckets, HISTORY_BUCKETS),
    "history_without_family": (history_without_family, HISTORY_WITHOUT), "regimes_explode": (regimes_explode, REGIMES),
}
