"""Assertions, privacy rules and job control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, hierarchy as h
from .base import EV, evaluation, r6, rounded, table
from .metrics import err


def audit_dupkeys(spark, d):
    return audit.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


AUDIT_DUPKEYS = "SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"


def audit_predictions(spark, d):
    ev = evaluation(spark, d)
    return audit.failures(ev, in_range=F.col("prediction").between(1000, 70000), finite=~F.isnan("prediction"), positive=F.col("target") > 0, known=F.col("regime").isin("A", "N"))


AUDIT_PREDICTIONS = f"""WITH {EV} SELECT count(*) FILTER (NOT prediction BETWEEN 1000 AND 70000) AS in_range, count(*) FILTER (isnan(prediction)) AS finite, count(*) FILTER (NOT target > 0) AS positive,
  count(*) FILTER (regime NOT IN ('A', 'N')) AS known, count(*) AS checked FROM ev"""


def audit_recompute(spark, d):
    """The nested metric against the same metric by weights."""
    ev = evaluation(spark, d)
    a = h.nested_mean(ev, ["regime"], mae=err()).select("regime", "mae")
    w = h.origin_weights(ev, ["regime"]).select("regime", "session_key", "weight")
    b = ev.join(w, ["regime", "session_key"]).groupBy("regime").agg(F.sum(err() * F.col("weight")).alias("mae"))
    return rounded(audit.recomputed(a, b, ["regime"], "mae", 5e-6), "value_a", "value_b")


AUDIT_RECOMPUTE = f"""WITH {EV}, s AS (SELECT regime, user_key, session_key, avg(abs(prediction - target)) AS e FROM ev GROUP BY ALL), u AS (SELECT regime, user_key, avg(e) AS e FROM s GROUP BY ALL),
a AS (SELECT regime, avg(e) AS a FROM u GROUP BY ALL),
n AS (SELECT regime, user_key, session_key, count(*) AS n FROM ev GROUP BY ALL), ns AS (SELECT regime, user_key, count(*) AS ns FROM n GROUP BY ALL), nu AS (SELECT regime, count(*) AS nu FROM ns GROUP BY ALL),
b AS (SELECT regime, sum(abs(prediction - target) / (nu * ns * n)) AS b FROM ev JOIN n USING (regime, user_key, session_key) JOIN ns USING (regime, user_key) JOIN nu USING (regime) GROUP BY ALL)
SELECT regime, round(a, 6) AS value_a, round(b, 6) AS value_b, abs(a - b) <= 5e-6 AS ok FROM a JOIN b USING (regime)"""


def job_matrix(spark, d):
    """Every nation and segment must have customers of the three expected balances."""
    c = table(spark, d, "customer")
    expected = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")).crossJoin(F.broadcast(c.select("c_mktsegment").distinct()))
    kind = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").when(F.col("c_acctbal") < 9900, "high").otherwise("odd")
    return audit.job_matrix(expected, c.withColumn("file", kind), ["c_nationkey", "c_mktsegment"], ["debt", "low", "high"])


JOB_MATRIX = """WITH f AS (SELECT c_nationkey, c_mktsegment, list_distinct(list(CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' WHEN c_acctbal < 9900 THEN 'high' ELSE 'odd' END)) AS fs FROM customer GROUP BY ALL),
e AS (SELECT n_nationkey AS c_nationkey, c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c_nationkey, c_mktsegment, CASE WHEN fs IS NULL THEN 'pending' WHEN list_contains(fs, 'odd') THEN 'invalid' WHEN len(fs) < 3 THEN 'incomplete' ELSE 'complete' END AS status,
  coalesce(len(fs), 0)::INT AS n_files FROM e LEFT JOIN f USING (c_nationkey, c_mktsegment)"""


def privacy_columns(spark, d):
    """The columns of all tables, and names as other tools write them."""
    tables = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    names = [(t, c) for t in tables for c in table(spark, d, t).columns]
    names += [("planted", n) for n in ("User_ID", " Session Key ", "\ufefftimestamp", "my-athlete-id", "users", "mean_hr", "Origin.Time", "ride_user_id", "user")]
    return audit.private_columns(spark.createDataFrame(names, "tab string, col string"), "col")


PRIVACY_COLUMNS = """WITH c AS (SELECT table_name AS tab, column_name AS col FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem',
    'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
  UNION ALL SELECT 'planted', unnest(['User_ID', ' Session Key ', chr(65279) || 'timestamp', 'my-athlete-id', 'users', 'mean_hr', 'Origin.Time', 'ride_user_id', 'user']))
SELECT tab, col, (tab = 'events' AND col = 'user_id') OR (tab = 'planted' AND col NOT IN ('users', 'mean_hr', 'user')) AS private FROM c"""


def k_anonymity(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("users"), F.sum((F.col("c_acctbal") < 0).cast("long")).alias("debt_users"))
    return audit.small_groups(g, ["users", "debt_users"], 10)


K_ANONYMITY = """SELECT * FROM (SELECT c_nationkey, c_mktsegment, count(*) AS users, count(*) FILTER (c_acctbal < 0) AS debt_users FROM customer GROUP BY ALL) WHERE users < 10 OR debt_users < 10"""


def resume_antijoin(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    done = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return audit.unprocessed(o, done, ["o_orderkey"])


RESUME = "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)"


def union_parts(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return audit.merged_parts([c.where(F.col("c_custkey") % 3 == i) for i in range(3)] + [c.where("c_custkey % 5 = 0")], ["c_custkey"])


UNION_PARTS = "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"


def pivot_pairs(spark, d):
    m = h.point_metrics(evaluation(spark, d), ["regime", "horizon", "mode"]).select("regime", "horizon", "mode", "mae")
    return rounded(audit.mode_pairs(m, ["regime", "horizon"], "mode", "mae", "F", "O"), "F", "O", "delta")


PIVOT_PAIRS = f"""WITH {EV}, s AS (SELECT regime, horizon, mode, user_key, session_key, avg(abs(prediction - target)) AS e FROM ev GROUP BY ALL), u AS (SELECT regime, horizon, mode, user_key, avg(e) AS e FROM s GROUP BY ALL),
m AS (SELECT regime, horizon, mode, avg(e) AS mae FROM u GROUP BY ALL)
SELECT a.regime, a.horizon, round(a.mae, 6) AS "F", round(b.mae, 6) AS "O", round(a.mae - b.mae, 6) AS delta FROM m a JOIN m b ON a.regime = b.regime AND a.horizon = b.horizon WHERE a.mode = 'F' AND b.mode = 'O'"""


def tree_hash(spark, d):
    p = table(spark, d, "part")
    return audit.set_hash(p, ["p_brand"], F.concat_ws("|", F.col("p_partkey").cast("string"), "p_type"))


TREE_HASH = """WITH x AS (SELECT p_brand, sha256(concat_ws('|', p_partkey, p_type)) AS x FROM part),
p AS (SELECT p_brand, substr(x, 1, 3) AS p, sha256(string_agg(x, chr(10) ORDER BY x)) AS d, count(*) AS n FROM x GROUP BY ALL)
SELECT p_brand, sha256(string_agg(d, chr(10) ORDER BY p)) AS digest, sum(n)::BIGINT AS items FROM p GROUP BY ALL"""


def leak_optimism(spark, d):
    """Relative optimism of the errors under one mode against the other, in per cent."""
    m = h.nested_mean(evaluation(spark, d), ["mode", "horizon"], mae=err()).groupBy("horizon").pivot("mode", ["F", "O"]).agg(F.first("mae"))
    return m.select("horizon", r6(100 * (F.col("O") - F.col("F")) / F.col("O")).alias("optimism"))


LEAK_OPTIMISM = f"""WITH {EV}, s AS (SELECT mode, horizon, user_key, session_key, avg(abs(prediction - target)) AS e FROM ev GROUP BY ALL), u AS (SELECT mode, horizon, user_key, avg(e) AS e FROM s GROUP BY ALL),
m AS (SELECT mode, horizon, avg(e) AS e FROM u GROUP BY ALL)
SELECT horizon, round(100 * (max(e) FILTER (mode = 'O') - max(e) FILTER (mode = 'F')) / max(e) FILTER (mode = 'O'), 6) AS optimism FROM m GROUP BY ALL"""

PLANS = {
    "audit_dupkeys": (audit_dupkeys, AUDIT_DUPKEYS), "audit_predictions": (audit_predictions, AUDIT_PREDICTIONS), "audit_recompute": (audit_recompute, AUDIT_RECOMPUTE),
    "job_matrix": (job_matrix, JOB_MATRIX), "privacy_columns": (privacy_columns, PRIVACY_COLUMNS), "k_anonymity": (k_anonymity, K_ANONYMITY),
    "resume_antijoin": (resume_antijoin, RESUME), "union_parts": (union_parts, UNION_PARTS), "pivot_pairs": (pivot_pairs, PIVOT_PAIRS), "tree_hash": (tree_hash, TREE_HASH),
    "leak_optimism": (leak_optimism, LEAK_OPTIMISM),
}
