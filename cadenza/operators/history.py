"""What a user had completed before a session starts.

Only sessions that ended by the start count, and only sessions that started earlier.  Instead of a non-equi
self-join, ends and starts become events in one order per user, and running sums over them give
every feature; a user's events are sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the thirteen features, in order.
FEATURES = [
    "log_count", "log_duration_mean", "log_duration_sd", "value_mean", "value_mean_sd", "value_sd_mean", "speed_mean",
    "speed_mean_sd", "altitude_sd_mean", "log_same_count", "same_value_mean", "same_speed_mean", "log_days_since",
]


def causal_history(sessions: DataFrame, user: str, key: str, family: str, start: str, end: str, value_mean: str, value_sd: str,
                   speed_mean: str, altitude_sd: str, counts: Column | None = None, day: float = 86_400.0) -> DataFrame:
    """(user, key, prior_count, mask, the FEATURES).

    counts: sessions that may enter a history (default all); a family kept out of training is left out here.
    A session of no duration that ends when it starts doesn't enter the history of sessions of the same start:
    at equal times ends sort before starts, but an end whose own start is the same time sorts after them.
    """
    enters = F.lit(True) if counts is None else counts
    duration = (F.col(end) - F.col(start)).cast("double")
    cols = {"d": duration, "v": F.col(value_mean), "vs": F.col(value_sd), "s": F.col(speed_mean), "al": F.col(altitude_sd)}
    base = sessions.select(
        F.col(user).alias("u"), F.col(key).alias("k"), F.col(family).alias("f"), F.col(start).alias("a"), F.col(end).alias("b"),
        enters.alias("enters"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in cols.items()])
    ends = base.where("enters").select("u", "f", F.col("b").alias("t"), F.when(F.col("a") == F.col("b"), 2).otherwise(0).alias("kind"),
                                       F.lit(None).cast(base.schema["k"].dataType).alias("k"), "a", *cols)
    starts = base.select("u", "f", F.col("a").alias("t"), F.lit(1).alias("kind"), "k", "a",
                         *[F.lit(None).cast("double").alias(n) for n in cols])
    events = ends.unionByName(starts)
    # Ranges of (t, kind): sums over rows up to the current one; rows of one start see the same ends.
    order = Window.partitionBy("u").orderBy("t", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("u", "f").orderBy("t", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.col("kind") != 1
    total = lambda c, w: F.coalesce(F.sum(F.when(done, c)).over(w), F.lit(0.0))
    w = events.withColumn("n", F.sum(done.cast("long")).over(order)).withColumn("same_n", F.sum(done.cast("long")).over(same))
    for name in cols:
        w = w.withColumn(f"t_{name}", total(F.col(name), order))
    for name in ("d", "v", "s"):
        w = w.withColumn(f"q_{name}", total(F.col(name) * F.col(name), order))
    w = w.withColumn("m_v", total(F.col("v"), same)).withColumn("m_s", total(F.col("s"), same)).withColumn(
        "previous", F.max(F.when(done, F.col("a"))).over(order))
    rows = w.where("kind = 1")
    n, sn = F.nullif(F.col("n"), F.lit(0)), F.nullif(F.col("same_n"), F.lit(0))
    mean = lambda c: F.coalesce(F.col(f"t_{c}") / n, F.lit(0.0))
    sd = lambda c: F.coalesce(F.sqrt(F.greatest(F.col(f"q_{c}") / n - F.pow(F.col(f"t_{c}") / n, 2), F.lit(0.0))), F.lit(0.0))
    days = F.greatest(F.lit(0.0), (F.col("t") - F.col("previous")).cast("double")) / day
    values = [
        F.log1p("n"), F.log1p(mean("d")), F.log1p(sd("d")), mean("v"), sd("v"), mean("vs"), mean("s"), sd("s"), mean("al"),
        F.log1p("same_n"), F.coalesce(F.col("m_v") / sn, F.lit(0.0)), F.coalesce(F.col("m_s") / sn, F.lit(0.0)),
        F.log1p(F.coalesce(days, F.lit(0.0))),
    ]
    return rows.select(
        F.col("u").alias(user), F.col("k").alias(key), F.col("n").alias("prior_count"), (F.col("n") > 0).alias("mask"),
        *[F.when(F.col("n") > 0, v).otherwise(0.0).alias(name) for name, v in zip(FEATURES, values, strict=True)])


def masked(history: DataFrame, zero: Column) -> DataFrame:
    """The zero-history mode: no mask, all features 0."""
    return history.withColumn("mask", ~zero & F.col("mask")).withColumns(
        {f: F.when(zero, 0.0).otherwise(F.col(f)) for f in FEATURES if f in history.columns})


def availability(history: DataFrame, user: str, by: list[str]) -> DataFrame:
    """Sessions with 0, 1-4, 5-9 and 10 or more completed ones before, and users with any and with none but such."""
    n = F.col("prior_count")
    has = history.groupBy(*by, user).agg(
        F.count("*").alias("s"), F.sum((n == 0).cast("long")).alias("n0"), F.sum(n.between(1, 4).cast("long")).alias("n1"),
        F.sum(n.between(5, 9).cast("long")).alias("n5"), F.sum((n >= 10).cast("long")).alias("n10"),
        F.bool_or(n > 0).alias("any_"), F.bool_and(n > 0).alias("all_"))
    return has.groupBy(*by).agg(
        F.sum("s").alias("sessions"), F.sum("n0").alias("none"), F.sum("n1").alias("one_to_four"), F.sum("n5").alias("five_to_nine"),
        F.sum("n10").alias("ten_or_more"), F.count("*").alias("users"), F.sum(F.col("any_").cast("long")).alias("users_any"),
        F.sum(F.col("all_").cast("long")).alias("users_all"))
