"""Operator 10: mixing sources to target weights by Pfair scheduling.

Every source has an integer share a of a period of A slots (sum of shares = A).  Block k = 1, 2,
... of a source is released at slot floor((k-1)A/a) and due before slot ceil(kA/a); one block runs
in each slot, the released one with the earliest deadline (ties: the source that sorts first).
The windows come from a fair fluid schedule, so earliest deadline first meets all of them, and
after any number of slots each source has had its share to within less than one block.

The windows repeat every A slots, so only one period is simulated, on the driver.  A is `period`, or
SLOTS_A_SOURCE times the number of sources if that is more, so the driver's cost grows with the sources
and not with the documents; a long schedule is written and joined by a shuffle.  Block k of a source then lands at slot
((k-1) div a) * A + slot of its ((k-1) mod a + 1)-th block in the period.  Placing the documents
is an equi-join with that table (A rows).  When a source runs out its slots stay empty and
the others keep their order, so every document is placed exactly once.

Documents of a source are taken in order of a hash of their id.  Their rank within the source
never needs a source in one task: rows are counted in (source, hash range) cells, cells
are summed up in order in two levels, and rows are ranked within their cell.

Contract of `mixed`: a null source is a source of its own; a source without a weight gets weight
`other` (default: the least given one); text may be null or of any length, it isn't read; repeated
rows are placed one after the other; null ids sort first; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, documents

#: Slots of a period: the resolution of the weights.
PERIOD = 10_000
#: Documents in a block.
BLOCK_DOCS = 16
#: Slots of a period for each source, at least.
SLOTS_A_SOURCE = 5
#: The schedule is broadcast up to this many slots.
BROADCAST_SLOTS = 100_000
#: Rows ranked together in one (source, hash range) cell, on average, at most.
CELL_ROWS = 2_000
#: Cells that are summed up in one task.
CELLS = 4_096


def shares(weights: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Integer shares of a period, at least 1 each, by largest remainders (ties: name)."""
    if not weights:
        return {}
    if len(weights) > period:
        raise ValueError("more sources than slots")
    total = sum(weights.values())
    ideal = {s: w / total * period for s, w in weights.items()}
    got = {s: max(1, math.floor(x)) for s, x in ideal.items()}
    key = lambda s: (s is not None, s or "")
    by_rest = sorted(ideal, key=lambda s: (got[s] - ideal[s], key(s)))
    left = period - sum(got.values())
    for i in range(left):
        got[by_rest[i % len(by_rest)]] += 1
    # Slots given beyond the period are taken back where the excess is largest, but nobody's last one.
    place = {s: i for i, s in enumerate(sorted(got, key=key))}
    excess = [(ideal[s] - n, -n, -place[s], s) for s, n in got.items() if n > 1] if left < 0 else []
    heapq.heapify(excess)
    for _ in range(-left):
        *_, s = heapq.heappop(excess)
        got[s] -= 1
        if got[s] > 1:
            heapq.heappush(excess, (ideal[s] - got[s], -got[s], -place[s], s))
    return got


def period_schedule(share: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, j, release, deadline, slot) for one period, earliest deadline first among the released."""
    period = sum(share.values())
    names = sorted(share, key=lambda s: (s is not None, s or ""))
    window = lambda a, j: ((j - 1) * period // a, -(-j * period // a))
    waiting = [(0, i, 1) for i in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(share[names[i]], j)[1], i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline was missed")
        out.append((names[i], j, release, deadline, slot))
        if j < share[names[i]]:
            heapq.heappush(waiting, (window(share[names[i]], j + 1)[0], i, j + 1))
    return out


def ranked_in_source(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds rank (0, 1, ...) within src by (hash, id), without ever gathering a source."""
    rows = rows.withColumn("h", F.xxhash64(F.lit("mix"), "id"))
    n = rows.count()
    cells = max(1, -(-n // CELL_ROWS))
    # Cells are equal ranges of the upper 31 bits of the hash, so cell order is hash order.
    top = F.shiftrightunsigned("h", 33)
    flipped = F.when(top >= 2**30, top - 2**30).otherwise(top + 2**30)
    rows = scratch.keep(rows.withColumn("cell", F.floor(flipped * F.lit(cells) / F.lit(2.0**31)).cast("long")), "ranks")
    # Rows before a cell: those of the earlier stretches of CELLS cells, and those before it in its own stretch.
    counts = rows.groupBy("src", "cell").agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("cell") / F.lit(CELLS)))
    counts = scratch.keep(counts, "cells")
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = counts.groupBy("src", "stretch").agg(F.sum("n").alias("n")).select(
        F.col("src").alias("s_src"), F.col("stretch").alias("s_stretch"), upto(Window.partitionBy("src").orderBy("stretch")).alias("earlier"))
    before = (
        counts.withColumn("own", upto(Window.partitionBy("src", "stretch").orderBy("cell")))
        .join(stretches, F.col("src").eqNullSafe(F.col("s_src")) & (F.col("stretch") == F.col("s_stretch")))
        .select(F.col("src").alias("c_src"), F.col("cell").alias("c_cell"), (F.col("own") + F.col("earlier")).alias("before")))
    inner = Window.partitionBy("src", "cell").orderBy("h", F.col("id").asc_nulls_first())
    return (
        rows.withColumn("r", F.row_number().over(inner) - 1)
        .join(before, F.col("src").eqNullSafe(F.col("c_src")) & (F.col("cell") == F.col("c_cell")))
        .withColumn("rank", F.col("before") + F.col("r"))
        .drop("c_src", "c_cell", "before", "r")
    )


def mixed(df: DataFrame, weights: dict[str | None, float] | None = None, other: float | None = None,
          period: int = PERIOD, block: int = BLOCK_DOCS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, block, release, deadline, slot, place) per row.

    weights: target weight of each source; None: the square root of its number of documents, so that
    large sources are damped.  slot orders the blocks of the mixture, place the documents in a block.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("src"))
    found = rows.groupBy("src").agg(F.count("*").alias("n")).collect()
    period = max(period, SLOTS_A_SOURCE * len(found))
    if weights is None:
        target = {r.src: math.sqrt(r.n) for r in found}
    else:
        rest = other if other is not None else min(weights.values(), default=1.0)
        target = {r.src: weights.get(r.src, rest) for r in found}
    share = shares(target, period)
    plan = spark.createDataFrame(
        [(s, share[s], j, a, d, t) for s, j, a, d, t in period_schedule(share)],
        "p_src string, share long, j long, a long, d long, t long")
    held = F.broadcast
    if period > BROADCAST_SLOTS:
        plan, held = scratch.keep(plan, "schedule"), lambda x: x
    placed = (
        ranked_in_source(rows, scratch)
        .withColumn("block", F.floor(F.col("rank") / F.lit(block)).cast("long"))
        .join(held(plan.select("p_src", "share").distinct().withColumnRenamed("p_src", "s_src")),
              F.col("src").eqNullSafe(F.col("s_src")))
        .withColumn("turn", F.floor(F.col("block") / F.col("share")).cast("long"))
        .withColumn("own_j", F.col("block") - F.col("turn") * F.col("share") + 1)
        .join(held(plan.drop("share")), F.col("src").eqNullSafe(F.col("p_src")) & (F.col("own_j") == F.col("j")))
    )
    base = F.col("turn") * F.lit(period)
    return placed.select(
        F.col("id").alias(id_col), F.col("src").alias(source_col), "block",
        (base + F.col("a")).alias("release"), (base + F.col("d")).alias("deadline"), (base + F.col("t")).alias("slot"),
        (F.col("rank") - F.col("block") * F.lit(block)).cast("long").alias("place"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, sources weighted by the square root of their size."""
    return mixed(documents(spark, sf_dir))
