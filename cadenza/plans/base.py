"""Views that several queries start from, in both languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Six digits (or fewer), by way of nine: where a mean lies halfway, the last bit of a sum would decide otherwise."""
    return F.rint(F.rint((F.col(c) if isinstance(c, str) else c) * 1e9) / 1e9 * 10.0**digits) / 10.0**digits


def rounded_alike(sql: str) -> str:
    """The same arithmetic in the queries' twins, for round(x, 6) or round(x, 4) as written: engines differ in how they round decimals' halves."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + 6 : end - 1]
        out += sql[at:start]
        digits = inner[-1] if inner.endswith((", 4", ", 6")) else None
        out += f"(round_even(round_even(({rounded_alike(inner[:-3])}) * 1e9, 0) / 1e9 * 1e{digits}, 0) / 1e{digits})" if digits else f"round({rounded_alike(inner)})"
        at = end
    return out + sql[at:]


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r6(n, digits) for n in names})


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users, orders as sessions, lines as forecasts of the price from the quantity."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("session_key"), (1 + F.col("l_linenumber") % 3).alias("horizon"), F.col("l_returnflag").alias("regime"),
        F.col("l_linestatus").alias("mode"), F.col("l_extendedprice").alias("target"), (F.col("l_quantity") * 1500.0).alias("prediction"),
        "l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("session_key"), F.col("o_custkey").alias("user_key"), F.col("o_orderpriority").alias("family"), "o_orderdate")
    return lines.join(orders, "session_key")


EV = """ev AS (
  SELECT o_custkey AS user_key, l_orderkey AS session_key, 1 + l_linenumber % 3 AS horizon, l_returnflag AS regime,
    l_linestatus AS mode, l_extendedprice AS target, l_quantity * 1500.0::DOUBLE AS prediction, l_quantity, l_discount, l_tax,
    l_partkey, l_suppkey, l_linenumber, l_shipdate, o_orderpriority AS family, o_orderdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sessions in days: a start, a deterministic duration, a family."""
    o = table(spark, d, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return o.select(
        F.col("o_custkey").alias("user_key"), F.col("o_orderkey").alias("session_key"), F.col("o_orderpriority").alias("family"),
        day.alias("start_day"), (day + 1 + F.pmod(F.col("o_orderkey"), F.lit(90))).alias("end_day"),
        F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


SESS = """sess AS (
  SELECT o_custkey AS user_key, o_orderkey AS session_key, o_orderpriority AS family,
    date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS start_day,
    (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 1 + o_orderkey % 90)::BIGINT AS end_day,
    o_totalprice AS price, o_orderstatus AS status
  FROM orders)"""
