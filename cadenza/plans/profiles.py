"""Profiles, cross-source equality and residual models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import close
from ..operators import inference, models, profiles as pf
from ..operators.hierarchy import user_means
from .base import EV, evaluation, r6, rounded, table
from .metrics import REPLICATES, draws, err
from .signals import BINS, BY, _bins


def profile_resample(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", pf.resampled(F.col("embedding"), 48).alias("p"))
    return e.select("vec_id", r6(F.element_at("p", 1)).alias("first"), r6(F.element_at("p", 24)).alias("mid"), r6(F.element_at("p", 48)).alias("last"),
                    r6(F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).alias("total"))


PROFILE_RESAMPLE = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, range(48) AS ii FROM embeddings),
p AS (SELECT vec_id, list_transform(ii, lambda i: v[floor(i * 63 / 47.0::DOUBLE)::INT + 1] + (v[least(floor(i * 63 / 47.0::DOUBLE)::INT + 2, 64)] - v[floor(i * 63 / 47.0::DOUBLE)::INT + 1])
  * (i * 63 / 47.0::DOUBLE - floor(i * 63 / 47.0::DOUBLE))) AS p FROM e)
SELECT vec_id, round(p[1], 6) AS first, round(p[24], 6) AS mid, round(p[48], 6) AS last, round(list_sum(p), 6) AS total FROM p"""


def profile_eligibility(spark, d):
    return rounded(pf.eligibility(_bins(spark, d), BY, 8, 0.8, 2, 20.0), "coverage", "sd")


PROFILE_ELIGIBILITY = f"""WITH {BINS}, g AS (SELECT *, bin - lag(bin) OVER (PARTITION BY user_id, session_no ORDER BY bin) - 1 AS gap FROM bins),
s AS (SELECT user_id, session_no, max(bin) - min(bin) + 1 AS span, count(*) AS n, coalesce(max(gap), 0) AS missing_run, stddev_pop(value) AS sd FROM g GROUP BY ALL)
SELECT user_id, session_no, span, round(n / span, 6) AS coverage, missing_run, round(sd, 6) AS sd, CASE WHEN span < 8 THEN 'span_too_short' WHEN n / span < 0.8::DOUBLE THEN 'coverage'
  WHEN missing_run > 2 THEN 'missing_run' WHEN sd < 20 THEN 'flat_signal' END AS reason FROM s"""


def profile_variants(spark, d):
    e = table(spark, d, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * 100)
    return e.select("vec_id", F.explode(pf.variants(scaled, [0.0, 0.1, 0.2], [0.0, 2.0], 4.0, 16)).alias("digest"))


def exact_xsource(spark, d):
    docs = table(spark, d, "documents")
    digest = F.sha2(F.lower(F.trim("text")).cast("binary"), 256)
    return pf.across_sources(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "doc_id", digest)


EXACT_XSOURCE = """WITH x AS (SELECT doc_id, source, sha256(lower(trim(text))) AS digest FROM documents),
l AS (SELECT digest, min(doc_id) AS left_key, count(*) AS left_n FROM x WHERE source = 'src0' GROUP BY ALL), r AS (SELECT digest, min(doc_id) AS right_key, count(*) AS right_n FROM x WHERE source <> 'src0' GROUP BY ALL)
SELECT * FROM l JOIN r USING (digest)"""


def quantile_model(spark, d):
    q = models.residual_quantiles(evaluation(spark, d), ["family"], F.col("regime") == "N", "target", "prediction", 0.0, 200000.0)
    return q.groupBy("family").agg(*[r6(F.avg(F.element_at("quantiles", i + 1))).alias(f"q{round(100 * x):02d}") for i, x in enumerate(models.LEVELS)], F.count("*").alias("n"))


_Q = ", ".join(f"round(avg(greatest(0.0, least(200000.0, prediction + r[{i}]))), 6) AS q{round(100 * x):02d}" for i, x in enumerate(models.LEVELS, 1))
QUANTILE_MODEL = f"""WITH {EV}, f AS (SELECT family, quantile_cont(target - prediction, {models.LEVELS}::DOUBLE[]) AS r FROM ev WHERE regime = 'N' GROUP BY ALL)
SELECT family, {_Q}, count(*) AS n FROM ev JOIN f USING (family) GROUP BY ALL"""


def linear_residual(spark, d):
    ev = evaluation(spark, d).withColumn("w", 1 / (1 + F.col("l_linenumber")))
    out = models.linear_residual(ev, ["l_quantity", "l_discount", "l_tax"], F.col("regime") == "N", "target", "prediction", "w", 0.0, 200000.0)
    return out.groupBy("regime").agg(F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mae"), F.count("*").alias("n"))


def approx_equal(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.sum(close(F.col("l_discount"), F.lit(0.05)).cast("long")).alias("equal"), F.count("*").alias("n"))


APPROX_EQUAL = "SELECT l_returnflag, count(*) FILTER (abs(l_discount - 0.05::DOUBLE) <= 1e-8 + 1e-5 * 0.05) AS equal, count(*) AS n FROM lineitem GROUP BY ALL"


def two_sample(spark, d):
    users = user_means(evaluation(spark, d), ["mode"], mae=err())
    return rounded(inference.poisson_two_sample(users, "mode", "F", "O", "mae", "user_key", REPLICATES), "difference", "ratio", "low", "high", "ratio_low", "ratio_high", digits=4)


TWO_SAMPLE = f"""WITH {EV}, s AS (SELECT mode, user_key, session_key, avg(abs(prediction - target)) AS e FROM ev GROUP BY ALL), u AS (SELECT mode, user_key, avg(e) AS mae FROM s GROUP BY ALL),
x AS (SELECT r, sum(w * mae) / sum(w) AS x FROM {draws("(SELECT * FROM u WHERE mode = 'F')", 'user_key', 1)} GROUP BY ALL), y AS (SELECT r, sum(w * mae) / sum(w) AS y FROM {draws("(SELECT * FROM u WHERE mode = 'O')", 'user_key', 2)} GROUP BY ALL),
p AS (SELECT avg(mae) FILTER (mode = 'F') AS a, avg(mae) FILTER (mode = 'O') AS b FROM u)
SELECT round(any_value(a - b), 4) AS difference, round(any_value(a / b), 4) AS ratio, round(quantile_cont(x - y, 0.025), 4) AS low, round(quantile_cont(x - y, 0.975), 4) AS high,
  round(CASE WHEN min(y) > 0 THEN quantile_cont(x / y, 0.025) END, 4) AS ratio_low, round(CASE WHEN min(y) > 0 THEN quantile_cont(x / y, 0.975) END, 4) AS ratio_high FROM x JOIN y USING (r), p"""


PLANS = {
    "profile_resample": (profile_resample, PROFILE_RESAMPLE), "profile_eligibility": (profile_eligibility, PROFILE_ELIGIBILITY), "profile_variants": (profile_variants, None),
    "exact_xsource": (exact_xsource, EXACT_XSOURCE), "quantile_model": (quantile_model, QUANTILE_MODEL), "linear_residual": (linear_residual, None),
    "approx_equal": (approx_equal, APPROX_EQUAL), "two_sample": (two_sample, TWO_SAMPLE),
}
