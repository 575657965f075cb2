"""Exact duplicate groups and their resolution, time linkage, and signed random projections for vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What a duplicate without a decision of its own counts as (fixed value).
NOT_DUPLICATE = "not_in_duplicate_group"


def with_actions(rows: DataFrame, actions: DataFrame, key: str, eligible: Column) -> DataFrame:
    """Adds the duplicate action (NOT_DUPLICATE where there is none) and `analysis_eligible`: eligible and not excluded.

    actions: one row a key."""
    out = rows.join(actions.select(key, "action"), key, "left").withColumn("action", F.coalesce("action", F.lit(NOT_DUPLICATE)))
    return out.withColumn("analysis_eligible", F.coalesce(eligible, F.lit(False)) & (F.col("action") != "exclude"))


def fingerprint(*fields: Column) -> Column:
    """Digest of fields with explicit framing, so neighbours can't run into each other."""
    framed = [F.concat(F.coalesce(f.cast("string"), F.lit("<missing>")), F.lit("\u001f")) for f in fields]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def exact_groups(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """Rows with digest, group_size and least (the group's least key, which names it): members of groups of two and more.

    A null digest is in no group.  Repeated rows are members of their own.  `numbered` gives groups their numbers.
    Group sizes come from a partial aggregate; the members are joined back on the digest, a join that Spark
    splits where one group is very large."""
    rows = df.withColumn("digest", digest)
    groups = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(key).alias("least")).where("group_size > 1")
    return rows.join(groups, "digest")


def numbered(members: DataFrame) -> DataFrame:
    """(least, group_no): groups numbered from 1 by their least key, in two levels."""
    from .hierarchy import running

    return running(members.select("least").distinct(), [], "least").select("least", (F.col("before") + 1).cast("long").alias("group_no"))


def resolved(members: DataFrame, key: str, user: str, family: str) -> DataFrame:
    """Decision and action for every member: groups of several users go, then groups of several families, else
    the least key stays."""
    d = members.groupBy("digest").agg(
        F.min(user).alias("u0"), F.max(user).alias("u1"), F.min(family).alias("f0"), F.max(family).alias("f1"), F.min(key).alias("canonical"))
    decision = (
        F.when(F.col("u0") != F.col("u1"), "exclude_all_cross_user_identity_conflict")
        .when(F.col("f0") != F.col("f1"), "exclude_all_sport_family_conflict")
        .otherwise("keep_one_within_user_family_consistent"))
    out = members.join(d.withColumn("decision", decision).select("digest", "decision", "canonical"), "digest")
    kept = (F.col("decision") == "keep_one_within_user_family_consistent") & (F.col(key) == F.col("canonical"))
    reason = (
        F.when(F.col("decision") == "exclude_all_cross_user_identity_conflict", "exact_signal_duplicate_across_users")
        .when(F.col("decision") == "exclude_all_sport_family_conflict", "exact_signal_duplicate_with_family_conflict")
        .when(kept, "first_deterministic_key_within_user_and_family")
        .otherwise("redundant_exact_duplicate_of_kept_canonical"))
    return out.withColumn("action", F.when(kept, "keep_canonical").otherwise("exclude")).withColumn("reason", reason).drop("canonical")


def linked_by_offset(files: DataFrame, rides: DataFrame, by: str, file_key: str, local: str, ride_key: str, utc: str,
                     minutes: int = 840, step: int = 15) -> DataFrame:
    """(by, file_key, status, ride_key, offset): a ride's UTC time plus a multiple of `step` minutes is the file's local time.

    A link counts only if it is the only one on both sides.  Files and rides are dealt once, by `by`; what follows keeps that partitioning, so
    neither the possible times of a ride nor its hits are ever shuffled.  A ride meets the distinct times of files in its span (two of
    the spans that time is cut into at most) that differ from it by a whole number of steps.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    minute, last = 60_000_000, 2 * minutes // step * step - minutes
    width = 4 * (minutes + last + step) * minute
    named = files.select(by, F.col(file_key).alias("_file"), micros(local).alias("_t"))
    known = F.col(by).isNotNull() & F.col("_t").isNotNull()
    probes = rides.select(by, F.col(ride_key).alias("_ride"), micros(utc).alias("_t")).where(known & F.col("_ride").isNotNull())
    rows = named.where(known).unionByName(probes, allowMissingColumns=True).repartition(by)
    is_ride = F.col("_ride").isNotNull()
    # a file's time lies in one span, a ride's possible times in as many as its first and last one touch
    def span(shift: int) -> Column:
        t = F.col("_t") + F.lit(shift * minute)
        return F.round((t - F.pmod(t, F.lit(width))) / F.lit(width)).cast("long")

    rows = rows.withColumn("_phase", F.pmod(F.col("_t") - F.when(is_ride, minutes * minute).otherwise(0), F.lit(step * minute))).withColumn(
        "_span", F.explode(F.when(is_ride, F.sequence(span(-minutes), span(last))).otherwise(F.array(span(0)))))
    times = F.collect_set(F.when(~is_ride, F.col("_t"))).over(Window.partitionBy(by, "_phase", "_span"))
    near = F.filter("_times", lambda x: x.between(F.col("_t") - minutes * minute, F.col("_t") + last * minute))
    hits = rows.withColumn("_times", times).withColumn("_at", F.explode(F.when(is_ride, near).otherwise(F.array("_t"))))
    hits = hits.select(by, "_file", "_ride", F.col("_at").alias("_t"), F.when(is_ride, ((F.col("_at") - F.col("_t")) / minute).cast("int")).alias("offset"))
    hits = hits.withColumn("_hits", F.when(is_ride, F.count("*").over(Window.partitionBy(by, "_ride"))))
    at = Window.partitionBy(by, "_t")
    only = F.col("_hits") == 1
    found = hits.select(
        by, "_file", "_ride", F.count(F.when(~is_ride, 1)).over(at).alias("_same"), F.max("_hits").over(at).alias("_most"),
        F.count(F.when(only, 1)).over(at).alias("_single"), F.max(F.when(only, F.struct(F.col("_ride").alias("ride"), "offset"))).over(at).alias("_hit"))
    status = (
        F.when(F.col("_same") > 1, "duplicate_csv_timestamp")
        .when(F.col("_most") > 1, "ambiguous_timestamp_match")
        .when(F.col("_single") == 1, "linked")
        .when(F.col("_single") > 1, "duplicate_metadata_match")
        .otherwise("unmatched_timestamp"))
    linked = F.col("status") == "linked"
    out = found.where(~is_ride).withColumn("status", status).select(
        by, F.col("_file").alias(file_key), "status", F.when(linked, F.col("_hit.ride")).alias(ride_key), F.when(linked, F.col("_hit.offset")).alias("offset"))
    status = F.when(F.col("_t").isNull(), "unparsable_csv_timestamp").otherwise("unmatched_timestamp")
    none = lambda c: F.lit(None).cast(out.schema[c].dataType).alias(c)
    return out.unionByName(named.where(~known).select(by, F.col("_file").alias(file_key), status.alias("status"), none(ride_key), none("offset")))


def projections(dimension: int, tables: int = 12, bits: int = 24, seed: int = 20260722) -> np.ndarray:
    """(tables * bits, dimension) random directions of unit length."""
    rows = np.random.default_rng(seed).standard_normal((tables * bits, dimension))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def signatures(df: DataFrame, key: str, vector: str, directions: np.ndarray, bits: int, *keep: str) -> DataFrame:
    """(key, keep, table, signature): the signs of `bits` projections of the z-scored vector, the first one in bit 0, for each table.

    Vectors that are null, of another length or constant have no signature.  Signs come from one matrix product an Arrow batch."""
    import pyarrow as pa

    tables = len(directions) // bits
    power = (1 << np.arange(bits, dtype=np.int64))

    def run(batches):
        for batch in batches:
            rows = batch.column(vector).to_pylist()
            some = [i for i, x in enumerate(rows) if x is not None and len(x) == directions.shape[1] and None not in x]
            x = np.array([rows[i] for i in some], dtype=np.float64).reshape(len(some), directions.shape[1])
            sd = x.std(axis=1)
            x, some = x[sd > 0], np.array(some, dtype=np.int64)[sd > 0]
            z = (x - x.mean(axis=1, keepdims=True)) / sd[sd > 0][:, None]
            found = ((z @ directions.T >= 0).reshape(len(some), tables, bits) * power).sum(axis=2)
            at = pa.array(np.repeat(some, tables))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in (key, *keep)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(some))), pa.array(found.ravel())],
                names=[key, *keep, "table", "signature"])

    kinds = dict(df.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in (key, *keep)] + ["table int", "signature long"])
    return df.select(key, *keep, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, schema)


def candidate_pairs(left: DataFrame, right: DataFrame, key: str, span: str, most: float) -> DataFrame:
    """Distinct (left_key, right_key) of different sources that share a (table, signature) and whose spans differ by at
    most `most` of the longer one.

    A span names the three neighbouring bands of its logarithm, so the join's keys include the duration and rows of a
    bucket meet only those of about their length; collapse exact copies before, as they share all buckets."""
    band = F.floor(F.log(F.col(span).cast("double")) / F.lit(float(-np.log(1 - most)))).cast("long")
    l = left.select(F.col(key).alias("left_key"), "table", "signature", F.col(span).alias("_a"), band.alias("_band"))
    r = right.select(F.col(key).alias("right_key"), "table", "signature", F.col(span).alias("_b"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
    near = F.abs(F.col("_a") - F.col("_b")) <= F.lit(most) * F.greatest("_a", "_b")
    return l.join(r, ["table", "signature", "_band"]).where(near).select("left_key", "right_key").distinct()


#: Pairs whose signals are compared at once, so that they stay in the processor's cache.
COMPARED = 512


def _profiles(column, points: int | None, width: int) -> np.ndarray:
    """One row for each list of an Arrow column, resampled at `points` places (None: as it is, if `width` long); NaN where a list is null,
    empty, of another length or has a null."""
    from .profiles import resampled_rows

    sizes = np.asarray(column.value_lengths().fill_null(0))
    out = np.full((len(sizes), width), np.nan)
    for size in [width] if points is None else np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        x = column.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        out[at] = x if points is None else resampled_rows(x, points)
    return out


def _agreement(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and 95th percentile (linear between neighbours) of the absolute gaps, and the correlation, NaN where a side is constant."""
    n = x.shape[1]
    gap = np.abs(x - y)
    mae = gap.sum(axis=1) / n
    place = 0.95 * (n - 1)
    low, high = int(place), min(int(place) + 1, n - 1)
    ordered = np.partition(gap, sorted({low, high}), axis=1)
    p95 = ordered[:, low] + (ordered[:, high] - ordered[:, low]) * (place - low)
    p95[np.isnan(mae)] = np.nan
    u, v = x - x.sum(axis=1, keepdims=True) / n, y - y.sum(axis=1, keepdims=True) / n
    su, sv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    varied = (su > 1e-12) & (sv > 1e-12)
    r = np.full(len(x), np.nan)
    r[varied] = (u * v).sum(axis=1)[varied] / np.sqrt(su[varied] * sv[varied])
    return mae, p95, r


def agreements(pairs: DataFrame, sides: list[tuple[str, str, str, bool]], points: int | None, limits: dict[str, float] | None = None, keep_signals: bool = False) -> DataFrame:
    """Adds {name}mae, {name}p95 and {name}r of each (left, right, name, leveled) of `sides`: two array columns, resampled at `points` places;
    leveled ones less their medians.  Null where a signal is null, empty or has a null (r: or is constant).  Without points, all signals of a side
    are of one length.

    limits: mae, p95 and r of the first side; pairs that break one are left out.  Signals are dropped unless they are kept.  Rows are
    compared with NumPy, many at a time, and each by itself, so equal pairs get equal values."""
    import pyarrow as pa

    signals = [c for x, y, *_ in sides for c in (x, y)]
    kept = [c for c in pairs.columns if keep_signals or c not in signals]
    added = [name + m for _, _, name, _ in sides for m in ("mae", "p95", "r")]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, COMPARED):
                batch = whole.slice(start, COMPARED)
                found = []
                for x, y, _, leveled in sides:
                    both = [batch.column(c) for c in (x, y)]
                    width = points or max(1, *(c.value_lengths().fill_null(0).to_numpy().max(initial=0) for c in both))
                    u, v = (_profiles(c, points, width) for c in both)
                    if leveled:
                        u, v = (z - np.median(z, axis=1, keepdims=True) for z in (u, v))
                    found += _agreement(u, v)
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(z, from_pandas=True) for z in found)], names=[*kept, *added])
                if limits is not None:
                    mae, p95, r = found[:3]
                    out = out.filter(pa.array((mae <= limits["mae"]) & (p95 <= limits["p95"]) & (r >= limits["r"])))
                yield out

    kinds = dict(pairs.dtypes)
    wide = pairs.withColumns({c: F.col(c).cast("array<double>") for c in signals})
    kinds |= dict.fromkeys(signals, "array<double>")
    return wide.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{c}` double" for c in added]))


def verified(pairs: DataFrame, limits: dict[str, float], points: int | None = None) -> DataFrame:
    """Pairs without their signals, with mae, p95, r of the signals (columns a, b), resampled at `points` places, support by speed (sa, sb) and altitude
    (ta, tb), and a status of three.

    limits: mae, p95, r of the signal; speed_mae, speed_r; altitude_mae, altitude_r (altitudes less their medians).  A null or
    constant auxiliary signal gives no support; a constant signal is screened out."""
    p = agreements(pairs, [("a", "b", "", False), ("sa", "sb", "speed_", False), ("ta", "tb", "altitude_", True)], points).drop("speed_p95", "altitude_p95")
    good = lambda e, r, name: F.coalesce((F.col(e) <= limits[name + "mae"]) & (F.col(r) >= limits[name + "r"]), F.lit(False))
    signal = good("mae", "r", "") & (F.col("p95") <= limits["p95"])
    support = good("speed_mae", "speed_r", "speed_") | good("altitude_mae", "altitude_r", "altitude_")
    return p.withColumn("status", F.when(signal & support, "near_candidate_hr_plus_auxiliary").when(signal, "near_candidate_hr_only")
                        .otherwise("screened_out_after_continuous_verification"))


def framed_digest(version: str, head: bytes, fields: list[tuple[str, bytes]]) -> str:
    """SHA-256 of a version, a head, and fields each with the lengths of its name and body in front."""
    import hashlib
    import struct

    out = hashlib.sha256(version.encode() + head)
    for name, body in fields:
        out.update(struct.pack("<I", len(name)) + name.encode() + struct.pack("<Q", len(body)) + body)
    return out.hexdigest()


def signal_digests(df: DataFrame, key: str, grid: int, channels: list[str], points: int = 48, quantum: float = 4.0, offsets: tuple[float, ...] = (0.0, 2.0),
                   crops: tuple[tuple[int, int], ...] = ((0, 0), (1, 0), (0, 1))) -> DataFrame:
    """(key, exact, trimmed, profiles) of sessions on a common grid, whose channels are arrays of doubles with null where nothing was observed.

    exact: digest of all channels' 32-bit values and masks, whatever the clock; trimmed: of the first channel from its first to its
    last observed bin; profiles: distinct digests of the first channel cropped by bins at either end, interpolated at
    `points` places and quantised after each offset.  The last two are null and empty where nothing is observed."""
    import hashlib
    import struct

    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                fields, first = [], None
                for name in channels:
                    given = row[name] if row[name] is not None else []
                    x = np.array([np.nan if v is None else v for v in given], dtype=np.float64)
                    mask = ~np.isnan(x)
                    values = np.where(mask, x, 0.0).astype("<f4")
                    fields += [(f"{name}_values_f32_le", values.tobytes()), (f"{name}_mask_u8", mask.astype(np.uint8).tobytes())]
                    first = (values, mask) if first is None else first
                values, mask = first
                exact = framed_digest("normalized-10s-float32-v1", struct.pack("<II", grid, len(values)), fields)
                seen = np.flatnonzero(mask)
                trimmed, profiles = None, []
                if len(seen):
                    a, b = int(seen[0]), int(seen[-1])
                    trimmed = framed_digest("trimmed-exact-hr-f32-v1", struct.pack("<I", b + 1 - a), [
                        ("hr_values_f32_le", values[a : b + 1].tobytes()), ("hr_mask_u8", mask[a : b + 1].astype(np.uint8).tobytes())])
                    for left, right in crops:
                        c, d = a + left, b - right
                        at = seen[(seen >= c) & (seen <= d)]
                        if c >= d or len(at) < 2:
                            continue
                        profile = np.interp(np.linspace(c, d, points), at, values[at].astype(np.float64))
                        for offset in offsets:
                            q = np.rint((profile + offset) / quantum).astype("<i2")
                            profiles.append(hashlib.sha256(b"trimmed-normalized-profile-v1" + struct.pack("<I", points) + q.tobytes()).hexdigest())
                out.append((row[key], exact, trimmed, list(dict.fromkeys(profiles))))
            yield pd.DataFrame(out, columns=[key, "exact", "trimmed", "profiles"])

    return df.select(key, *channels).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, exact string, trimmed string, profiles array<string>")


def best_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the least by the given order, as a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")).select(key, "_b.*")


def even_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even places floor((i + 0.5) N / n) of the order (ties: the other columns); all rows if there are no more than n.

    Rows before a value are counted in two levels, so no task sees all rows; only values that hold a place are joined back."""
    from .hierarchy import running

    places = running(df, [], order)
    slot = lambda x: F.floor(x.cast("double") * n / F.col("total")).cast("long")
    near = F.sequence(F.greatest(slot(F.col("before")) - 1, F.lit(0).cast("long")), slot(F.col("before") + F.col("w")) + 1)
    held = F.filter(F.transform(near, lambda s: F.floor((s + 0.5) * F.col("total") / n)), lambda x: (x >= F.col("before")) & (x < F.col("before") + F.col("w")))
    chosen = places.withColumn("_places", held).where((F.size("_places") > 0) | (F.col("total") <= n)).select(order, "before", "total", "_places")
    rest = [c for c in df.columns if c != order]
    tied = df.join(chosen, order).withColumn("_i", F.row_number().over(Window.partitionBy(order).orderBy(*(rest or [order]))) - 1 + F.col("before"))
    return tied.where((F.col("total") <= n) | F.array_contains("_places", F.col("_i"))).select(*df.columns)
