"""Operator 1: near-duplicate groups by fast similarity sketching, banding and exact verification.

Contract of `near_duplicates` (one row per input row):
  null or empty text, or no words    empty set: n_shingles 0, linked with nothing, kept
  fewer than `shingle` words         the whole word sequence is the one shingle
  identical sets                     always linked (found by digest, never by pairs)
  repeated ids                       one result row each, same component; all texts of an id give it links
  null id                            result row with null component, linked with nothing, kept
  empty table                        empty result
  other columns                      ignored, whatever their names

Nodes are distinct sets, known by the 128-bit digest of the set, so an id with several texts is several nodes.

How a hot group is handled.  Copies collapse to one node before any bucket is formed.  Buckets get as
label their member with the most copies (a partial aggregate); the pairs to verify are those inside the group of
a label.  A group of up to BLOCK members is verified in one task on the full sets.  A larger one is cut into
blocks.  First every member is compared with a few pivots: members linked with the first pivot, or with one that
it reaches through pivots, are one component, and pairs among them can't add anything.  Then each remaining member is compared with
all members, block by block.  So a group of m near copies is sent about once and not m / BLOCK times; tasks return
spanning forests of their links; no pair leaves a task, no group meets in one task, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, documents, keyed_join, rows_of
from .sketch import band_keys, bands_for, sketches
from .textcore import SPACED_LOWER, U, Words, chunks, mix, seed_values, shingle_sets, text_buffers, trimmed

#: Members of a group that are verified together.
BLOCK = 128
#: Members of a large group that all others are compared with first.
PIVOTS = 8
#: Coordinates in a band.
BAND_ROWS = 5

_SKETCHED = "id long, n_shingles long, digest binary, bands array<long>"


def _digests(values: np.ndarray, ends: np.ndarray) -> list:
    """128-bit digest of each set (None for an empty one)."""
    sums = []
    for seed in seed_values(2, 4242):
        total = np.concatenate([[U(0)], np.cumsum(mix(values ^ seed), dtype=U)])
        sums.append(total[ends[1:]] - total[ends[:-1]])
    both = np.stack([*sums], axis=1)
    size = np.diff(ends)
    return [both[i].tobytes() + int(size[i]).to_bytes(4, "little") if size[i] else None for i in range(len(size))]


def _sketch_batches(shingle: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(*text_buffers(part.column("text")), SPACED_LOWER)
                values, ends = shingle_sets(words, shingle)
                keys = band_keys(sketches(values, ends, bands * BAND_ROWS), BAND_ROWS).view(np.int64)
                size = np.diff(ends)
                filled = np.where(size > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(size, pa.int64()),
                        pa.array(_digests(values, ends), pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(filled)]), pa.int32()),
                            pa.array(keys[size > 0].ravel(), pa.int64()),
                        ),
                    ],
                    names=["id", "n_shingles", "digest", "bands"],
                )

    return trimmed(run)


def _set_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(*text_buffers(part.column("text")), SPACED_LOWER)
                values, ends = shingle_sets(words, shingle)
                raw = values.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_digests(values, ends), pa.binary()), pa.array(sets, pa.binary())], names=["node", "items"]
                )

    return trimmed(run)


def close_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, as a square of booleans, by exact intersections.

    Intersections are matrix products over the items that occur at least twice, in column blocks.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    use = shared[where]
    owner, where = owner[use], column[where[use]]
    common = np.zeros((n, n), dtype=np.float32)
    columns = int(shared.sum())
    width = min(columns, max(256, (1 << 21) // n))
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    for start in range(0, columns, max(width, 1)):
        lo, hi = np.searchsorted(where, [start, start + width])
        held = np.zeros((n, width), dtype=np.float32)
        held[owner[lo:hi], where[lo:hi] - start] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    close = 100 * common.astype(np.int64) >= percent * union.astype(np.int64)
    np.fill_diagonal(close, False)
    return close


def forest(close: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent = list(range(len(close)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(close), strict=True):
        a, b = root(int(x)), root(int(y))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(x), int(y)))
    return out


def linked_pairs(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    return forest(close_pairs(sets, percent))


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype=U) for x in table.column("items").combine_chunks()]


def _links(ids: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([ids[x] for x, _ in links], pa.int64()), "b": pa.array([ids[y] for _, y in links], pa.int64())})


def _verify_group(percent: int):
    """All pairs of a small group."""

    def run(table: pa.Table) -> pa.Table:
        return _links(table.column("id").to_numpy(), linked_pairs(_sets(table), percent))

    return run


_COMPARED = "label binary, node binary, id long, a long, b long"


def _verify_pivots(percent: int):
    """Links between a block's members and the pivots of its group; members that aren't anchored come back with a null link.

    A member is anchored if it is linked with the first pivot (most bands), or with a pivot that this one reaches through
    links between pivots: all tasks of a group see all its pivots, so they agree."""

    def run(table: pa.Table) -> pa.Table:
        nodes, ids = table.column("node").to_pylist(), table.column("id").to_numpy()
        label = table.column("label")[0].as_py()
        pivot = table.column("pivot").to_numpy()
        close = close_pairs(_sets(table), percent)
        anchor = np.zeros(len(nodes), dtype=bool)
        anchor[max(np.flatnonzero(pivot), key=lambda i: (table.column("bands")[int(i)].as_py(), nodes[i]))] = True
        while True:
            more = pivot & (anchor | close[:, anchor].any(axis=1))
            if (more == anchor).all():
                break
            anchor = more
        loose = np.flatnonzero(~pivot & ~close[:, anchor].any(axis=1))
        links = forest(close & (pivot[:, None] | pivot[None, :]))
        n = len(loose)
        return pa.table({
            "label": pa.array([label] * (n + len(links)), pa.binary()),
            "node": pa.array([nodes[i] for i in loose] + [None] * len(links), pa.binary()),
            "id": pa.array([int(ids[i]) for i in loose] + [None] * len(links), pa.int64()),
            "a": pa.array([None] * n + [int(ids[x]) for x, _ in links], pa.int64()),
            "b": pa.array([None] * n + [int(ids[y]) for _, y in links], pa.int64())})

    return run


def _verify_loose(percent: int):
    """Links between some loose members and a block of all members."""

    def run(table: pa.Table) -> pa.Table:
        loose = table.column("loose").to_numpy()
        close = close_pairs(_sets(table), percent) & (loose[:, None] != loose[None, :])
        return _links(table.column("id").to_numpy(), forest(close))

    return run


def _large_groups(large: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) links of groups of over BLOCK members; large: (label, node, id, m)."""
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    large = scratch.keep(large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")), "large")
    # Of each of so many parts of the group, the member that shares the most bands in it: the likeliest centre.
    part = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(PIVOTS))
    pivots = scratch.keep(
        large.groupBy("label", part.alias("part")).agg(F.max(F.struct("bands", "node", "id", "blocks")).alias("p")).select("label", "p.*"), "pivots")
    dealt = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("pivot", F.lit(True)).unionByName(
        large.join(pivots.select("label", "node"), ["label", "node"], "left_anti").select("label", "bands", "node", "id", "blocks", "block").withColumn("pivot", F.lit(False)))
    compared = scratch.keep(
        dealt.join(sets, "node").groupBy("label", "block").applyInArrow(_verify_pivots(percent), _COMPARED), "compared")
    links = compared.where("a is not null").select("a", "b")

    loose = compared.where("a is null").select("label", "node", "id")
    counts = scratch.keep(loose.groupBy("label").agg(F.count("*").alias("n")), "loose-counts")
    if counts.isEmpty():
        return links
    rounds = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    sizes = scratch.keep(large.groupBy("label").agg(F.first("m").alias("m")).join(counts, "label"), "loose-sizes")
    members = keyed_join(large.select("label", "node", "id", "block"), sizes, ["label"], "m", large.count())
    few = keyed_join(loose, sizes.select("label", "m", "n", F.col("n").alias("size")), ["label"], "size", loose.count())
    pairs = (
        few.withColumn("round", F.pmod(F.xxhash64("node"), rounds).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / F.lit(BLOCK)).cast("int") - 1)))
        .withColumn("loose", F.lit(True)).select("label", "round", "block", "node", "id", "loose"))
    pairs = pairs.unionByName(
        members.withColumn("round", F.explode(F.sequence(F.lit(0), rounds - 1))).withColumn("loose", F.lit(False))
        .select("label", "round", "block", "node", "id", "loose"))
    return links.unionByName(
        pairs.join(sets, "node").groupBy("label", "round", "block").applyInArrow(_verify_loose(percent), "a long, b long"))


def near_duplicates(
    df: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    miss: float = 1e-6,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row; links are pairs with Jaccard >= percent / 100.

    A linked pair of different sets is missed by all bands with probability under `miss`
    (exact sets confirm every link, so nothing is linked wrongly).
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bands = bands_for(percent / 100, BAND_ROWS, miss)
    rows = scratch.keep(docs.mapInArrow(_sketch_batches(shingle, bands), _SKETCHED), "sketches")

    # One node for each distinct set; its id is the least one.
    named = rows.where("id is not null and digest is not null")
    classes = named.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    # Written, so that joins with it have plain shuffles on both sides, which Spark splits where one digest is hot.
    copied = scratch.keep(classes.where("copies > 1").select("digest", F.col("id").alias("rep")), "copied")
    # A node's bands come back by its id and digest, which no group of copies shares.
    members = (
        named.join(classes, ["id", "digest"])
        .dropDuplicates(["id", "digest"])
        .select(F.col("digest").alias("node"), "id", "copies", F.posexplode("bands").alias("band", "key"))
    )
    members = scratch.keep(members, "members")
    labels = scratch.keep(
        members.groupBy("band", "key")
        .agg(F.min(F.struct((-F.col("copies")).alias("c"), F.col("node"))).getField("node").alias("label"),
             F.count("*").alias("size"))
        .where("size > 1"), "labels")
    grouped = scratch.keep(
        keyed_join(members, labels, ["band", "key"], "size", members.count())
        .groupBy("label", "node", "id").agg(F.count("*").alias("bands")), "groups")
    scratch.drop("members", "labels")
    sizes = scratch.keep(grouped.groupBy("label").agg(F.count("*").alias("m")).withColumn("rows", F.col("m")), "sizes")
    dealt = scratch.keep(keyed_join(grouped, sizes, ["label"], "rows", grouped.count()), "dealt")
    sets = scratch.keep(
        rows_of(docs.where("id is not null"), grouped.select("id").distinct(), "id")
        .mapInArrow(_set_batches(shingle), "node binary, items binary").where("node is not null").dropDuplicates(["node"]), "sets")
    scratch.drop("groups", "sizes")
    links = dealt.where(F.col("m") <= BLOCK).join(sets, "node").groupBy("label").applyInArrow(_verify_group(percent), "a long, b long")
    large = dealt.where(F.col("m") > BLOCK)
    if not large.isEmpty():
        links = links.unionByName(_large_groups(large, sets, percent, scratch))
    # An id with several texts links them all, also one without words.
    several = scratch.keep(
        rows.where("id is not null").groupBy("id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y"))
        .where("x != y").select("id"), "several")
    if not several.isEmpty():
        own = rows_of(named.select("id", "digest"), several, "id").distinct().join(copied, "digest")
        links = links.unionByName(own.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a != b"))
    found, held = components(spark, links, "a", "b")
    scratch.drop("dealt", "sets", "several", "large", "pivots", "compared", "loose-counts", "loose-sizes")

    out = (
        rows.select("id", "n_shingles", "digest")
        .join(copied, "digest", "left")
        .withColumn("rep", F.coalesce("rep", "id"))
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")))
    )
    return out.select(
        F.col("id").alias(id_col), "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85, over the whole documents table."""
    return near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE
    WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS g
  FROM t),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, hash(unnest(g)) AS h FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT doc_id AS x, doc_id AS y FROM n
  UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN c USING (doc_id)
"""
