"""Assertions over results, privacy rules, expected-job matrices, resumable processing, metric reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PRIVATE_ENDINGS, PRIVATE_NAMES, field_name


#: Hexadecimal digits that deal items to the parts of a set's digest.
PARTS_HEX = 3


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(groups, rows): keys that occur more than once, and the rows they have."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def failures(df: DataFrame, **rules: Column) -> DataFrame:
    """One row: for every rule, the rows that break it (null counts as broken), from a single pass."""
    return df.agg(*[F.coalesce(F.sum((~F.coalesce(c, F.lit(False))).cast("long")), F.lit(0)).alias(n) for n, c in rules.items()],
                  F.count("*").alias("checked"))


def recomputed(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, value_a, value_b, ok): two results side by side; keys that one side lacks aren't ok."""
    both = a.select(*keys, F.col(value).alias("value_a")).join(b.select(*keys, F.col(value).alias("value_b")), keys, "full")
    return both.withColumn("ok", F.coalesce(F.abs(F.col("value_a") - F.col("value_b")) <= tolerance, F.lit(False)))


def job_matrix(expected: DataFrame, found: DataFrame, keys: list[str], needed: list[str]) -> DataFrame:
    """Status of every expected job: pending without files, incomplete without all needed, invalid with unknown ones."""
    files = found.groupBy(*keys).agg(F.collect_set("file").alias("files"))
    have = F.array(*[F.lit(x) for x in needed])
    status = (
        F.when(F.col("files").isNull(), "pending")
        .when(F.size(F.array_except("files", have)) > 0, "invalid")
        .when(F.size(F.array_except(have, F.col("files"))) > 0, "incomplete")
        .otherwise("complete"))
    return expected.join(files, keys, "left").withColumn("status", status).select(
        *keys, "status", F.coalesce(F.size("files"), F.lit(0)).alias("n_files"))


def private_columns(columns: DataFrame, name: str) -> DataFrame:
    """Adds `private`: the normalised name is on the list, or has an ending that betrays one; a null name isn't private."""
    plain = field_name(F.coalesce(F.col(name), F.lit("")))
    rule = plain.isin(PRIVATE_NAMES)
    for end in PRIVATE_ENDINGS:
        rule = rule | plain.endswith(end)
    return columns.withColumn("private", rule)


def small_groups(df: DataFrame, counts: list[str], k: int) -> DataFrame:
    """Rows in which any count lies in 0 <= count < k: must not be published."""
    rule = F.lit(False)
    for c in counts:
        rule = rule | ((F.col(c) >= 0) & (F.col(c) < k))
    return df.where(rule)


def support_flags(users: Column) -> list[Column]:
    return [(users < 25).alias("caution"), (users >= 50).alias("supported"), (users >= 30).alias("reportable"), (users >= 10).alias("releasable")]


def unprocessed(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def merged_parts(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Parts of one table, by name; a key in several parts keeps one row (they are equal by contract)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(keys)


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each key and metric."""
    return df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").where("value is not null")


def mode_pairs(df: DataFrame, keys: list[str], mode: str, value: str, first: str, second: str) -> DataFrame:
    """Keys that have both modes, side by side with their difference."""
    wide = df.groupBy(*keys).pivot(mode, [first, second]).agg(F.first(value))
    return wide.where(F.col(first).isNotNull() & F.col(second).isNotNull()).withColumn("delta", F.col(first) - F.col(second))


def set_hash(df: DataFrame, by: list[str], item: Column) -> DataFrame:
    """Digest of the multiset of items of each group (null items don't count): a tree of two levels.

    Items are hashed and dealt by the first PARTS_HEX digits of their hash; a part's digest is that of its sorted hashes, a line
    each, and the group's that of its parts' digests in order.  So a task holds one part, whatever the group's size."""
    rows = df.select(*by, F.sha2(item.cast("binary"), 256).alias("_h")).where("_h is not null").withColumn("_p", F.substring("_h", 1, PARTS_HEX))
    lines = lambda c: F.sha2(F.array_join(c, "\n").cast("binary"), 256)
    parts = rows.groupBy(*by, "_p").agg(lines(F.array_sort(F.collect_list("_h"))).alias("_d"), F.count("*").alias("_n"))
    return parts.groupBy(*by).agg(
        lines(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"])).alias("digest"), F.sum("_n").alias("items"))


def blocked_paths(files: DataFrame, path: str, prefixes: list[str], folders: list[str], endings: list[str], allowed: list[str]) -> DataFrame:
    """Adds `blocked`: the first rule that keeps a relative path out of a release (null: none).

    Prefixes, folder names and endings are compared in lower case; a path that no allowed pattern (regular expression) matches
    is `not_allowed`; a null path too."""
    low = F.lower(F.col(path))
    begins = [low.startswith(p.lower()) for p in prefixes]
    ends = [low.endswith(e.lower()) for e in endings]
    fits = [F.col(path).rlike(p) for p in allowed]
    either = lambda rules: F.coalesce(F.array_contains(F.array(*rules), True), F.lit(False)) if rules else F.lit(False)
    parts = F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(x.lower()) for x in folders])) if folders else F.lit(False)
    return files.withColumn("blocked", F.when(either(begins), "location").when(parts, "folder").when(either(ends), "type").when(~either(fits), "not_allowed"))


#: What a record must say before outcomes of the external source may be computed (fixed value).
FROZEN = "frozen_before_external_inference"


def freeze_errors(record: dict, artifacts: dict[str, str]) -> list[str]:
    """What is wrong with a freeze record: its status, its flag, and artifacts (name -> digest) that are missing or changed."""
    found = [] if record.get("status") == FROZEN else ["status"]
    if record.get("external_outcomes_used_for_selection") is not False:
        found.append("external_outcomes_used_for_selection")
    held = record.get("artifacts")
    held = held if isinstance(held, dict) else {}
    return found + [name for name, digest in sorted(artifacts.items()) if not isinstance(held.get(name), dict) or held[name].get("sha256") != digest]


def json_keys(value, prefix: str = "") -> list[str]:
    """All keys of nested objects, also inside lists, by path."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in (f"{prefix}{k}", *json_keys(v, f"{prefix}{k}."))]
    if isinstance(value, list):
        return [p for v in value for p in json_keys(v, prefix)]
    return []


def postcondition_errors(result: dict, fields: list[str], positive: list[str]) -> list[str]:
    """Fields (by path) that a job's result lacks, counts that aren't positive, and its audit flag."""
    def at(path: str):
        value = result
        for k in path.split("."):
            value = value.get(k) if isinstance(value, dict) else None
        return value

    found = [] if result.get("all_assertions_pass") is True else ["all_assertions_pass"]
    found += [f for f in fields if at(f) is None]
    return found + [f for f in positive if not isinstance(at(f), (int, float)) or isinstance(at(f), bool) or at(f) <= 0]


def row_alignment(indices) -> str:
    """SHA-256 of row numbers as little-endian 64-bit integers: equal rows in equal order, or not."""
    import hashlib

    import numpy as np

    return hashlib.sha256(np.asarray(indices, dtype="<i8").tobytes()).hexdigest()


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys repeated on either side, and keys that only one side has; all zero if the sides match one to one."""
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = sides.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    count = lambda rule: F.coalesce(F.sum(rule.cast("long")), F.lit(0))
    return each.agg(count(F.col("l") > 1).alias("left_repeated"), count(F.col("r") > 1).alias("right_repeated"),
                    count(F.col("r") == 0).alias("left_only"), count(F.col("l") == 0).alias("right_only"))


def against_golden(found: DataFrame, golden: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Reported numbers: (keys, reported, recomputed, status): ok, differs, missing (not recomputed) or unreported."""
    both = golden.select(*keys, F.col(value).alias("reported"), F.lit(True).alias("_g")).join(
        found.select(*keys, F.col(value).alias("recomputed"), F.lit(True).alias("_f")), keys, "full")
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_g").isNull(), "unreported").when(
        F.abs(F.col("reported") - F.col("recomputed")) <= tolerance, "ok").otherwise("differs")
    return both.withColumn("status", status).drop("_g", "_f")
