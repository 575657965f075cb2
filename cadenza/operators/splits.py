"""Leakage-safe partitions of users, sessions and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import row_fraction, stable_fraction

#: Upper ends of the half-open ranges of the user split (fixed values).
USER_RANGES = [("train", 0.70), ("validation", 0.80), ("calibration", 0.90), ("test", 1.01)]
#: Least number of sessions of a user for a split in time (fixed value).
LEAST_SESSIONS = 10
INSUFFICIENT = "insufficient_user_history"
EXCLUDED = "excluded"
#: Share of external users that may be used for adaptation (fixed value).
ADAPTATION_SHARE = 0.20


def by_fraction(fraction: Column, ranges: list[tuple[str, float]]) -> Column:
    rule = None
    for name, end in ranges:
        rule = F.when(fraction < end, name) if rule is None else rule.when(fraction < end, name)
    return rule


def user_split(users: DataFrame, user: str, namespace: str) -> DataFrame:
    """Adds fraction and partition; a user's rows always share a partition."""
    return users.withColumn("fraction", stable_fraction(namespace, F.col(user))).withColumn(
        "partition", by_fraction(F.col("fraction"), USER_RANGES))


def temporal_split(sessions: DataFrame, user: str, start: str, key: str) -> DataFrame:
    """First 70, then 10, 10 and 10 per cent of a user's sessions in order of start (ties: key).

    The bounds are floor(share * n) in double arithmetic; users with too few sessions are set apart.
    """
    order = Window.partitionBy(user).orderBy(start, key)
    counted = sessions.withColumn("n", F.count("*").over(Window.partitionBy(user))).withColumn(
        "position", F.row_number().over(order) - 1)
    bound = lambda share: F.floor(F.lit(share).cast("double") * F.col("n"))
    part = (
        F.when(F.col("n") < LEAST_SESSIONS, INSUFFICIENT)
        .when(F.col("position") < bound(0.70), "train")
        .when(F.col("position") < bound(0.80), "validation")
        .when(F.col("position") < bound(0.90), "calibration")
        .otherwise("test")
    )
    return counted.withColumn("partition", part)


def strict_temporal(split: DataFrame, user: str, start: str, end: str) -> DataFrame:
    """Adds `strict`: sessions that overlap a boundary between partitions of their user are excluded.

    A session goes if it ends at or after the first start of any later partition, or starts at or before the
    last end of any earlier one.  Partition extremes are four numbers a user, so one aggregate and one join do.
    """
    names = ["train", "validation", "calibration", "test"]
    extremes = split.where(F.col("partition").isin(names)).groupBy(user).agg(
        *[F.min(F.when(F.col("partition") == p, F.col(start))).alias(f"first_{i}") for i, p in enumerate(names)],
        *[F.max(F.when(F.col("partition") == p, F.col(end))).alias(f"last_{i}") for i, p in enumerate(names)])
    joined = split.join(extremes, user, "left")
    bad = F.lit(False)
    for i, p in enumerate(names):
        later = [F.col(f"first_{j}") for j in range(i + 1, 4)]
        earlier = [F.col(f"last_{j}") for j in range(i)]
        own = F.lit(False)
        for x in later:
            own = own | F.coalesce(F.col(end) >= x, F.lit(False))
        for x in earlier:
            own = own | F.coalesce(F.col(start) <= x, F.lit(False))
        bad = bad | ((F.col("partition") == p) & own)
    drop = [f"{x}_{i}" for x in ("first", "last") for i in range(4)]
    return joined.withColumn("strict", F.when(bad, EXCLUDED).otherwise(F.col("partition"))).drop(*drop)


def external_split(sessions: DataFrame, user: str, family: str, namespace: str) -> DataFrame:
    """(user, adaptation): the first ceil(20 %) of each family's users by hash; chosen in one family, chosen in all."""
    pairs = sessions.select(user, family).distinct().withColumn(
        "fraction", stable_fraction_by(namespace, F.col(family), F.col(user)))
    from .hierarchy import order_statistics

    last = order_statistics(pairs, [family], "fraction", {"last": F.ceil(F.lit(ADAPTATION_SHARE).cast("double") * F.col("n"))})
    return pairs.join(last, family).groupBy(user).agg(F.max(F.col("fraction") <= F.col("last")).alias("adaptation"))


def stable_fraction_by(namespace: str, family: Column, key: Column) -> Column:
    """Fraction in a namespace of the family's own."""
    from ..functions.hashing import SPLIT_SEED, unit_fraction

    return unit_fraction(F.concat_ws("|", F.lit(SPLIT_SEED), F.lit(namespace), family, key.cast("string")))


def overlaps(df: DataFrame, part: str, key: str) -> DataFrame:
    """(left, right, shared keys) for every pair of partitions, from one distinct and one aggregate.

    Each key's set of partitions is at most the number of partitions, so the pairs are made inside a row.
    """
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(part)).alias("parts"))
    left = sets.select(F.col("parts"), F.explode("parts").alias("left"))
    pairs = left.select("left", F.explode("parts").alias("right")).where("left <= right")
    return pairs.groupBy("left", "right").agg(F.count("*").alias("shared"))


def held_out_family(sessions: DataFrame, user: str, family: str, held: str, user_part: str, train: str = "train",
                    test: str = "test") -> DataFrame:
    """Adds `role`: development rows lack the held family; its rows of training users test the family alone, those
    of test users test family and user together."""
    is_held = F.col(family) == held
    role = (
        F.when(~is_held & (F.col(user_part) != test), F.col(user_part))
        .when(is_held & (F.col(user_part) == train), "same_user")
        .when(is_held & (F.col(user_part) == test), "joint")
        .otherwise("unused")
    )
    return sessions.withColumn("role", role)


def shift_candidates(sessions: DataFrame, family: str, user: str, least_sessions: int, least_users: int) -> DataFrame:
    """Families with enough sessions and users to be held out."""
    return sessions.groupBy(family).agg(F.count("*").alias("sessions"), F.countDistinct(user).alias("users")).withColumn(
        "candidate", (F.col("sessions") >= least_sessions) & (F.col("users") >= least_users))


def contaminated_rows(rows: DataFrame, namespace: str, session: str, origin: str, partition: str, evaluation: Column,
                      ranges: list[tuple[str, float]] = USER_RANGES[:3]) -> DataFrame:
    """A deliberate leak.  Evaluated test rows stay the test; the other rows of their sessions are hashed into the other
    partitions; training rows, and evaluated validation and calibration rows, keep theirs; all others are unused (null)."""
    tested = rows.where((F.col(partition) == "test") & evaluation).select(session).distinct().withColumn("_tested", F.lit(True))
    fraction = row_fraction(namespace, F.col(session), F.col(origin))
    scaled = [(name, end / ranges[-1][1]) for name, end in ranges]
    clean = F.when(F.col(partition) == "train", "train").when(F.col(partition).isin("validation", "calibration") & evaluation, F.col(partition))
    hashed = F.coalesce(by_fraction(fraction, scaled), F.lit(ranges[-1][0]))
    is_test = F.col(partition) == "test"
    return rows.join(tested, session, "left").withColumn("leak_partition", F.when(is_test & evaluation, "test").when(
        is_test & F.col("_tested"), hashed).when(~is_test, clean)).withColumn("contamination", is_test & ~evaluation & F.coalesce("_tested", F.lit(False))).drop("_tested")


def proximity(test: DataFrame, train: DataFrame, by: list[str], t: str, limits: list[float], horizons: list[float], context: float) -> DataFrame:
    """One row: test rows, those near a training row of their group (by limit), the mean overlap of contexts, and exact
    collisions of target times by horizon and in any.  Collisions are an equi-join on target times."""
    near = nearest_distance(test, train, by, t, float("inf"))
    targets = train.select(*by, F.explode(F.array(*[F.col(t) + h for h in horizons])).alias("_at")).distinct().withColumn("_hit", F.lit(1))
    probes = test.withColumn("_row", F.monotonically_increasing_id()).select(*by, "_row", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), (F.col(t) + h).alias("at")) for i, h in enumerate(horizons)])).alias("p"))
    hits = probes.select(*by, "_row", "p.i", F.col("p.at").alias("_at")).join(targets, [*by, "_at"])
    collided = hits.agg(*[F.coalesce(F.sum((F.col("i") == i).cast("long")), F.lit(0)).alias(f"collisions_{i + 1}") for i in range(len(horizons))],
                        F.countDistinct("_row").alias("collided_rows"))
    shares = near.agg(
        F.count("*").alias("rows"), *[F.coalesce(F.sum((F.col("distance") <= x).cast("long")), F.lit(0)).alias(f"within_{int(x)}") for x in limits],
        F.avg(F.greatest(F.lit(0.0), context - F.col("distance"))).alias("overlap"))
    return shares.crossJoin(F.broadcast(collided))  # one row each


def nearest_distance(probes: DataFrame, anchors: DataFrame, by: list[str], t: str, limit: float) -> DataFrame:
    """Adds distance to the nearest anchor of the same group, null beyond `limit`.

    Anchors and probes are merged in one order; a probe's neighbours are the last anchor before it and, in the
    reverse order, the last anchor after it (an anchor at the same time is distance 0).
    """
    marked = probes.withColumn("is_probe", F.lit(1)).unionByName(
        anchors.select(*by, t).withColumn("is_probe", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy(t, "is_probe").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.col(t).desc(), "is_probe").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.when(F.col("is_probe") == 0, F.col(t))
    near = marked.withColumn("prev", F.last(anchor, True).over(before)).withColumn("next", F.last(anchor, True).over(after))
    distance = F.least(F.col(t) - F.col("prev"), F.col("next") - F.col(t))
    return near.where("is_probe = 1").withColumn("distance", F.when(distance <= limit, distance)).drop("is_probe", "prev", "next")
