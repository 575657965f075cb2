"""User -> session -> row hierarchies: nested means, point metrics, weights, standardisation.

Every mean is a chain of plain aggregates, so Spark combines partially before each shuffle and the
data shrink level by level: only the first aggregate sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER, SESSION = "user_key", "session_key"


def user_means(df: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Mean over the rows of a session, then over the sessions of a user."""
    keys = [*by, USER, SESSION]
    sessions = df.groupBy(*keys).agg(*[F.avg(c).alias(n) for n, c in values.items()], F.count("*").alias("n_rows"))
    return sessions.groupBy(*by, USER).agg(
        *[F.avg(n).alias(n) for n in values], F.count("*").alias("n_sessions"), F.sum("n_rows").alias("n_rows"))


def nested_mean(df: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Equal weight to every user, within it to every session, within it to every row."""
    users = user_means(df, by, **values)
    return users.groupBy(*by).agg(
        *[F.avg(n).alias(n) for n in values],
        F.count("*").alias("users"), F.sum("n_sessions").alias("sessions"), F.sum("n_rows").alias("origins"))


def point_metrics(df: DataFrame, by: list[str], target: str = "target", prediction: str = "prediction") -> DataFrame:
    """mae, rmse (root per session, before averaging), bias and supports."""
    error = F.col(prediction) - F.col(target)
    sessions = df.groupBy(*by, USER, SESSION).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"),
        F.count("*").alias("n"))
    users = sessions.groupBy(*by, USER).agg(
        *[F.avg(m).alias(m) for m in ("mae", "rmse", "bias")], F.count("*").alias("s"), F.sum("n").alias("n"))
    return users.groupBy(*by).agg(
        *[F.avg(m).alias(m) for m in ("mae", "rmse", "bias")],
        F.count("*").alias("users"), F.sum("s").alias("sessions"), F.sum("n").alias("origins"))


def session_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, user, session, n_origins, n_sessions of the user): one row a session."""
    sessions = df.groupBy(*by, USER, SESSION).agg(F.count("*").alias("n_origins"))
    users = sessions.groupBy(*by, USER).agg(F.count("*").alias("n_sessions"))
    return sessions.join(users, [*by, USER])


def origin_weights(df: DataFrame, by: list[str]) -> DataFrame:
    """Per session, the weight of each of its rows: 1 / (users * sessions of the user * rows of the session)."""
    sessions = session_counts(df, by)
    users = sessions.groupBy(*by).agg(F.countDistinct(USER).alias("n_users"))
    joined = sessions.join(users, by) if by else sessions.crossJoin(F.broadcast(users))  # one row without `by`
    return joined.withColumn("weight", 1 / (F.col("n_users") * F.col("n_sessions") * F.col("n_origins")))


def training_weights(df: DataFrame) -> DataFrame:
    """Per session, the weight of each of its rows: 1 / (rows * sessions of the user), scaled to a mean of 1 over rows."""
    sessions = session_counts(df, []).withColumn("raw", 1 / (F.col("n_origins") * F.col("n_sessions")))
    scale = sessions.agg((F.sum(F.col("raw") * F.col("n_origins")) / F.sum("n_origins")).alias("mean_raw"))
    return sessions.crossJoin(F.broadcast(scale)).withColumn("weight", F.col("raw") / F.col("mean_raw")).drop("raw", "mean_raw")


def users_of_sessions(df: DataFrame) -> DataFrame:
    """Sessions that belong to more than one user: must be empty."""
    return df.groupBy(SESSION).agg(F.countDistinct(USER).alias("users")).where("users > 1")


def shares(df: DataFrame, users: DataFrame, flag: Column) -> DataFrame:
    """Share of flagged sessions per user; users without any session have share 0."""
    own = df.groupBy(USER).agg(F.avg(flag.cast("double")).alias("share"))
    return users.join(own, USER, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def cell_means(df: DataFrame, cell: str, value: Column) -> DataFrame:
    """(user, cell, value, sessions): nested mean in each cell that a user has rows in."""
    sessions = df.groupBy(USER, cell, SESSION).agg(F.avg(value).alias("value"))
    return sessions.groupBy(USER, cell).agg(F.avg("value").alias("value"), F.count("*").alias("sessions"))


def full_cube(cells: DataFrame, cell: str, all_cells: DataFrame) -> DataFrame:
    """Every user with every cell (a bounded dimension, broadcast); missing combinations have null values."""
    every = cells.select(USER).distinct().crossJoin(F.broadcast(all_cells.select(cell)))
    return every.join(cells, [USER, cell], "left")


def standardized(cells: DataFrame, cell: str, mix: DataFrame) -> DataFrame:
    """Mean over users in each cell, weighted by the cell's share in `mix` (cell, share)."""
    means = cells.groupBy(cell).agg(F.avg("value").alias("value"))
    return means.join(mix, cell).agg(
        (F.sum(F.col("value") * F.col("share")) / F.sum("share")).alias("standardized"),
        F.avg("value").alias("macro"), F.count("*").alias("cells"))


#: Stretches of about equal size that a group's values are cut into, and values that decide where.
STRETCHES = 256
SAMPLED = 16_384


def running(df: DataFrame, by: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(by, value, w, before, total): each distinct value, its weight (default: rows), that of smaller values, and of all.

    Two levels: values are cut into STRETCHES of about equal size, stretches are summed up in one short window, and values within
    their stretch.  Where to cut is decided on about SAMPLED values, drawn by hash, so that a plan that is run twice cuts alike;
    results are exact.  Null values don't count; an empty table gives an empty result."""
    rows = df.where(F.col(value).isNotNull())
    if not by:
        return running(rows.withColumn("_all", F.lit(0)), ["_all"], value, weight).drop("_all")
    values = rows.groupBy(*by, value).agg((F.count("*") if weight is None else weight).alias("w"))
    sizes = values.groupBy(*by).agg(F.sum("w").alias("total"), F.greatest(F.lit(1), F.floor(F.count("*") / SAMPLED)).alias("_one_in"))
    sample = values.join(sizes, by).where(F.pmod(F.xxhash64(value), F.col("_one_in")) == 0)
    cuts = sample.groupBy(*by).agg(
        F.percentile(value, F.array(*[F.lit(i / STRETCHES) for i in range(1, STRETCHES)])).alias("_cuts"), F.first("total").alias("total"))
    own = values.join(cuts, by).withColumn("_stretch", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = own.groupBy(*by, "_stretch").agg(F.sum("w").alias("_weight_of")).select(*by, "_stretch", F.coalesce(F.sum("_weight_of").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*by, "_stretch").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return own.join(stretches, [*by, "_stretch"]).withColumn("before", F.col("_earlier") + F.coalesce(F.sum("w").over(inside), F.lit(0))).select(
        *by, value, "w", "before", "total")


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, one column a name): the value of each rank (from 1; an expression of n)."""
    rows = running(df, by, value).withColumnRenamed("total", "n")
    return rows.groupBy(*by).agg(
        F.max("n").alias("n"), *[F.min(F.when(F.col("before") + F.col("w") >= k, F.col(value))).alias(name) for name, k in ranks.items()])


def quantiles(df: DataFrame, by: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """(by, n, one column a name): quantiles, linear between order statistics."""
    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in levels.items()}
    ranks = {f"_{side}_{name}": F.floor(x) + 1 if side == "a" else F.ceil(x) + 1 for name, x in place.items() for side in ("a", "b")}
    found = order_statistics(df, by, value, ranks)
    line = lambda name: F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * (place[name] - F.floor(place[name]))
    return found.select(*by, "n", *[line(name).alias(name) for name in levels])


def weighted_quantile_higher(df: DataFrame, by: list[str], value: str, weight: str, p: float) -> DataFrame:
    """Least value whose cumulated weight reaches p of the total.

    Weights are summed up in two levels (`running`), so no task holds a group.
    """
    reached = running(df, by, value, F.sum(weight))
    return reached.where(F.col("before") + F.col("w") >= F.lit(p - 1e-12) * F.col("total")).groupBy(*by).agg(F.min(value).alias("quantile"))


def weighted_cdf(df: DataFrame, by: list[str], value: str, weight: str, thresholds: list[float]) -> DataFrame:
    """Weighted share of rows at or below each threshold."""
    total = F.sum(weight)
    wide = df.groupBy(*by).agg(
        *[(F.sum(F.when(F.col(value) <= t, F.col(weight)).otherwise(0.0)) / total).alias(f"t{i}") for i, t in enumerate(thresholds)])
    pairs = ", ".join(f"{t!r}D, t{i}" for i, t in enumerate(thresholds))
    return wide.selectExpr(*by, f"stack({len(thresholds)}, {pairs}) as (threshold, share)")


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rank within the group, ties at their mean rank."""
    order = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(order) + (F.count("*").over(ties) - 1) / 2)


def mean_user_spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Spearman correlation per user (enough rows, neither side constant), then its mean over users."""
    keys = [*by, USER]
    ranked = average_ranks(average_ranks(df.select(*keys, x, y), keys, x, "rx"), keys, y, "ry")
    users = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"), F.sum(F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("ry") * F.col("ry")).alias("syy"), F.sum(F.col("rx") * F.col("ry")).alias("sxy"))
    n = F.col("n")  # sums of ranks are exact, so a constant side has variance 0
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    rho = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.sqrt(vx * vy), F.lit(0.0))
    kept = users.withColumn("rho", rho).where((n >= least) & F.col("rho").isNotNull())
    return kept.groupBy(*by).agg(F.avg("rho").alias("spearman"), F.count("*").alias("users"))


def normalization(df: DataFrame, train: Column, value: str, floor: float = 1e-6) -> DataFrame:
    """Mean and standard deviation (population, variance floored) over the training rows, and z of every row."""
    moments = df.where(train).agg(F.avg(value).alias("mean"), F.sqrt(F.greatest(F.var_pop(value), F.lit(floor))).alias("sd"))
    return df.crossJoin(F.broadcast(moments)).withColumn("z", (F.col(value) - F.col("mean")) / F.col("sd"))


def seed_summary(df: DataFrame, by: list[str], seed: str, value: str) -> DataFrame:
    """Median, least and greatest over seeds, their number and list."""
    return df.groupBy(*by).agg(
        F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.countDistinct(seed).alias("n_seeds"),
        F.array_join(F.transform(F.array_sort(F.collect_set(seed)), lambda s: s.cast("string")), ";").alias("seeds"))


def numeric_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, p10, median, p90, max; quantiles interpolate linearly between order statistics."""
    return quantiles(df, by, value, {"low": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "high": 1.0})


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample standard deviation, and quantiles."""
    moments = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return quantiles(df, by, value, {f"p{int(100 * p):02d}": p for p in (0.05, 0.25, 0.5, 0.75, 0.95)}).join(moments, by)
