"""Scans: text lines with array fields, nested JSON, even samples, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dedupe import even_rows
from ..sources.readers import session_lines
from ..streaming.last_value import windowed_last
from .base import r6, table


def _lines(spark, d):
    """Each order as a dict-like text line, with blanks and words among its numbers."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").distinct()
    one = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    times = F.array_join(F.transform("x", lambda v: v["l_linenumber"].cast("string")), ", ")
    rates = F.array_join(F.transform("x", lambda v: F.when(v["l_partkey"] % 11 == 0, "None").when(v["l_partkey"] % 13 == 0, "nan").otherwise(v["l_quantity"].cast("int").cast("string"))), ", ")
    return one.select("l_orderkey", F.concat(F.lit("{'userId': "), (F.col("l_orderkey") % 10).cast("string"), F.lit(", 'id': "), F.col("l_orderkey").cast("string"),
                                             F.when(F.col("l_orderkey") % 4 == 0, "").otherwise(", 'sport': 'run'"), F.lit(", 'timestamp': ["), times, F.lit("], 'heart_rate': ["), rates, F.lit("]}")).alias("value"))


def src_text_arrays(spark, d):
    s = session_lines(_lines(spark, d))
    return s.select("l_orderkey", F.size("timestamp").alias("times"), F.size("heart_rate").alias("rates"), "aligned",
                    r6(F.aggregate("heart_rate", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_L = """li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem), v AS (SELECT l_orderkey, l_quantity::INT AS q, l_partkey % 11 <> 0 AND l_partkey % 13 <> 0 AS ok FROM li)"""
SRC_TEXT_ARRAYS = f"""WITH {_L} SELECT l_orderkey, count(*)::INT AS times, (count(*) FILTER (ok))::INT AS rates, count(*) = count(*) FILTER (ok) AS aligned,
  coalesce(sum(q) FILTER (ok), 0)::DOUBLE AS total FROM v GROUP BY ALL"""


def src_text_scalars(spark, d):
    return session_lines(_lines(spark, d)).select("user_id", "activity_id", "sport", "gender")


SRC_TEXT_SCALARS = """SELECT (l_orderkey % 10)::VARCHAR AS user_id, l_orderkey::VARCHAR AS activity_id, CASE WHEN l_orderkey % 4 = 0 THEN '<missing>' ELSE 'run' END AS sport, '<missing>' AS gender
FROM (SELECT DISTINCT l_orderkey FROM lineitem)"""


def json_explode(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", F.explode_outer("m").alias("name", "number"))


JSON_EXPLODE = """SELECT event_id, k AS name, json_extract(props, '$.' || k)::BIGINT AS number FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"""


def even_sample(spark, d):
    return even_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100)


EVEN_SAMPLE = """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_custkey FROM r WHERE n <= 100 OR i IN (SELECT floor((s + 0.5::DOUBLE) * (SELECT count(*) FROM orders) / 100)::BIGINT FROM range(100) t(s))"""


def top_labels(spark, d):
    """The thirty commonest labels; ties by label."""
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(30)


TOP_LABELS = "SELECT p_type, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_type LIMIT 30"


def windowed_last_value(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_last(e, ["user_id"], "ts", "value", "event_id", "1 day", "1 hour")
    return out.select("user_id", F.unix_seconds("start").alias("start_s"), "value", "n")


WINDOWED_LAST = """SELECT user_id, (floor(epoch_us(ts) / 86400000000.0::DOUBLE) * 86400)::BIGINT AS start_s, arg_max(value, struct_pack(t := ts, e := event_id)) AS value, count(*) AS n FROM events GROUP BY 1, 2"""

PLANS = {
    "src_text_arrays": (src_text_arrays, SRC_TEXT_ARRAYS), "src_text_scalars": (src_text_scalars, SRC_TEXT_SCALARS), "json_explode": (json_explode, JSON_EXPLODE),
    "even_sample": (even_sample, EVEN_SAMPLE), "top_labels": (top_labels, TOP_LABELS), "windowed_last": (windowed_last_value, WINDOWED_LAST),
}
