"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT = 2


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; rows of fold HELD_OUT are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def bounded_sample(rows: DataFrame, id_col: str, label_col: str, per_label: int, in_all: int | None = None) -> tuple[list[tuple], dict]:
    """Distinct (id, label) of about `per_label` rows of each label, and the number of rows of each label.

    in_all: rows of all labels together, at most; with many labels each has fewer, but one at least.  A row is drawn
    if a hash of its id lies under the label's threshold; the thresholds come from exact counts and are
    joined to the rows.  The draw is independent of partitions and needs no sort; the driver gets a row for each
    label and each drawn id (after the cut by hash order, exactly per_label a label at most), however often an id is repeated.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).agg(F.count("*")).collect()}
    if not counts:
        return [], {}
    if in_all is not None:
        per_label = max(1, min(per_label, in_all // len(counts)))
    whole = 1 << 30
    bars = {label: min(whole, int(whole * 1.1 * (per_label + 3 * per_label**0.5) / n) + 1) for label, n in counts.items()}
    of = rows.schema[label_col].dataType
    bars = rows.sparkSession.createDataFrame(sorted(bars.items(), key=str), f"own {of.simpleString()}, bar long")
    drawn = (
        rows.select(F.col(id_col), F.col(label_col), F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(whole)).alias("k"))
        .join(F.broadcast(bars), F.col(label_col).eqNullSafe(F.col("own")))  # a row a label, all of which the driver holds
        .where(F.col("k") < F.col("bar")).select(id_col, label_col, "k").distinct().collect())
    drawn.sort(key=lambda r: (r[2], str(r[0]), str(r[1])))
    out, held = [], dict.fromkeys(counts, 0)
    for i, label, _ in drawn:
        if held[label] < per_label:
            held[label] += 1
            out.append((i, label))
    return out, counts
