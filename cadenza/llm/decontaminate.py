"""Operator 4: benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is `window` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window.  The join works in three steps:

1. Rarity.  Every benchmark word is counted over all documents (one pass, partial counts).
2. Prefix.  Containment must be complete, so of a window's words ordered by rarity a prefix of
   one suffices: a document without that word cannot hold the window.  The prefix table has one
   row for each distinct window: its rarest word, that word's position, its length, its words.
3. Verification.  Each document word that is some prefix word proposes a start (its position
   less the prefix word's); starts before the first word or windows past the last are
   dropped by the positional and length bounds, and the words from there must equal
   the window's.  The condition is part of the join, so only verified hits leave it.

Texts are never shuffled: the prefix table is broadcast where its counted size allows, and
beyond that the words are joined by a shuffle on the prefix word instead.  A sentinel word at
the end of each document carries its word count through the same pass.

Contract: null text and empty text have no words (n_words 0, nothing hit); items that are null,
empty or without words have no window; equal windows of several items count for each of them;
items without an id have windows only with `unnamed` (op4 and the pipeline set it): they hit like
others and count as one item that has no place in item_ids; every document row gives a result row of
its own, whether its id is null or repeated; empty
tables give empty or all-clean results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, documents

#: The prefix table is broadcast up to this many distinct windows (some 150 bytes each).
BROADCAST_WINDOWS = 200_000

_UPPER = "".join(map(chr, range(65, 91)))
#: ASCII characters outside words once A-Z are lower-cased: 0-47, 58-96, 123-127.
_GAPS = "".join(map(chr, [*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]))
_END = "\u0000"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and non-ASCII characters."""
    flat = F.translate(text, _UPPER + _GAPS, _UPPER.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(flat, " "), "")


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str, unnamed: bool = False) -> DataFrame:
    """(win array, item_ids array, nameless int): each distinct window with the ids of its items, 1 if one has none."""
    tokens = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(
        "size(w) > 0" if unnamed else "size(w) > 0 and item is not null")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        tokens.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
        .groupBy("win")
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max(F.isnull("item").cast("int")).alias("nameless"))
    )


def prefix_table(windows: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, at, len, win, item_ids, nameless): each window under its rarest word over all documents.

    Ties go to the word that sorts first, then to its first position."""
    vocabulary = scratch.keep(windows.select(F.explode("win").alias("word")).distinct(), "vocabulary")
    held = F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_WINDOWS else vocabulary
    counts = scratch.keep(
        docs.select(F.explode("w").alias("word")).join(held, "word").groupBy("word").agg(F.count("*").alias("n")),
        "counts")
    ranked = (
        windows.withColumn("id", F.xxhash64("win"))
        .select("win", "item_ids", "nameless", "id", F.posexplode("win").alias("at", "word"))
        .join(counts, "word", "left")
        .groupBy("win")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("first"),
            F.first("item_ids").alias("item_ids"), F.first("nameless").alias("nameless"))
    )
    return ranked.select(
        F.col("first.word").alias("word"), F.col("first.at").alias("at"), F.size("win").alias("len"), "win", "item_ids",
        "nameless")


def contamination(
    df: DataFrame,
    items: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    unnamed: bool = False,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, item_ids, contaminated) per row."""
    scratch = Scratch(df.sparkSession)
    docs = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(words(F.col(text_col)), F.array().cast("array<string>")).alias("w"))
    windows = scratch.keep(item_windows(items, window, item_id, item_text, unnamed), "windows")
    table = scratch.keep(prefix_table(windows, docs, scratch), "prefixes")
    sentinel = df.sparkSession.range(1).select(
        F.lit(_END).alias("word"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("len"),
        F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("array<string>").alias("item_ids"),
        F.lit(0).alias("nameless"))
    small = table.count() <= BROADCAST_WINDOWS
    table = table.unionByName(sentinel)
    probe = docs.select("row", "id", "w", F.posexplode(F.concat("w", F.array(F.lit(_END)))).alias("pos", "key"))
    start = F.col("pos") - F.col("at")
    fits = (F.col("key") == F.col("word")) & (
        F.col("at").isNull()
        | ((start >= 0) & (start + F.col("len") <= F.size("w")) & (F.slice("w", start + 1, F.col("len")) == F.col("win")))
    )
    hits = probe.join(F.broadcast(table) if small else table, fits).select(
        "row", "id", F.when(F.col("at").isNull(), F.col("pos")).alias("n_words"),
        F.when(F.col("at").isNotNull(), F.struct(start.alias("s"), (start + F.col("len")).alias("e"))).alias("span"),
        "item_ids", "nameless")
    per_doc = hits.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("nameless").alias("nameless"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["last"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(acc["last"], x["e"]).alias("last")),
    ).getField("n")
    return per_doc.select(
        F.col("id").alias(id_col), "n_words", covered.alias("n_hit"),
        (F.size("item_ids") + F.col("nameless")).cast("long").alias("n_items"), "item_ids", (covered > 0).alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of the whole benchmark table against the whole documents table."""
    found = contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), window=10, unnamed=True)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 2)),
    lambda i: array_to_string(w[i:i+9], ' '))) AS g, least(len(w), 10) AS k
  FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(cov.n_hit, 0)::BIGINT AS n_hit,
  coalesce(its.n_items, 0)::BIGINT AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
  coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
