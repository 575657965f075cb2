"""From raw documents to mixed, tokenized training data.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame that
is written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents.

language        drops documents whose language the model rejects: no letter, or a score under
                the calibrated threshold, or too many unseen grams
near_dedup      keeps one document of each group of near copies (five-word shingles, 0.8), the one
                with the least id (null ids last); rows that only share an id are judged by their texts
decontaminate   drops documents that hold ten consecutive words of a benchmark item (or a whole
                shorter item)
mix             keeps every document and puts them in the order of the mixing schedule: file by
                file and row by row, any prefix has the target weights to within a block a source
tokens          writes the shards in that order, from the files where they lie (by doc_id if the rows
                don't come from files), and returns what it reads back: doc_id, start, n_tokens, ids_crc32

Null texts and empty texts are dropped by the first stage; null ids, null sources and null languages are
kept; empty tables stay empty.  Decisions are made for rows, not for ids: where an id is null or repeated, a
stage numbers its rows, and the numbers take the place of the ids.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.decontaminate import contamination
from cadenza.llm.language import accepted, fit
from cadenza.llm.mixing import mixed
from cadenza.llm.near_dedup import near_duplicates
from cadenza.llm.shared import BROADCAST_IDS, Scratch, documents
from cadenza.llm.tokens import tokenized, word_bpe

#: SQL can't express the language model or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


ROW = "pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds a long that tells rows apart: doc_id where no id is null or repeated, else a number written with the rows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).groupBy("id").count()
    if ids.where("id is null or count > 1").isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    return Scratch(docs.sparkSession).keep(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbered rows that aren't in rows, without the number; rows are broadcast only if few enough."""
    held = Scratch(docs.sparkSession).keep(rows, "dropped")
    return docs.join(F.broadcast(held) if held.count() <= BROADCAST_IDS else held, ROW, "left_anti").drop(ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    groups = near_duplicates(rows, shingle=5, percent=80, id_col=ROW).select(ROW, "component_id", "kept")
    if rows.where(~F.col(ROW).eqNullSafe(F.col("doc_id"))).isEmpty():
        return _without(rows, groups.where("not kept").select(ROW))
    # Numbers don't follow the ids, so the least id of each group is found anew.
    groups = Scratch(spark).keep(groups.join(rows.select(ROW, "doc_id"), ROW), "groups")
    least = groups.groupBy("component_id").agg(
        F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", F.col(ROW).alias("row"))).getField("row").alias("least"))
    return _without(rows, groups.join(least, "component_id").where(F.col(ROW) != F.col("least")).select(ROW))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    found = contamination(rows, documents(spark, sf_dir, "benchmark"), window=10, id_col=ROW, unnamed=True)
    return _without(rows, found.where("contaminated").select(ROW))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    placed = rows.join(mixed(rows, id_col=ROW).select(ROW, F.struct("slot", "place").alias("at")), ROW)
    return placed.repartitionByRange("at").sortWithinPartitions("at", "doc_id").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = F.col("_metadata.file_name")
    try:
        docs.select(name)
    except AnalysisException:  # not read from files
        return tokenized(docs, word_bpe(), 1)
    # Spark's writer numbers its files part-00000, ..., part-100000 and the pieces of one c000, ...: numbers, not names, are in order.
    number = F.coalesce(F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), F.lit(0)) * 100_000 + F.coalesce(
        F.regexp_extract(name, r"[-.]c(\d+)\.", 1).try_cast("long"), F.lit(0))
    return tokenized(docs, word_bpe(), 1, places=(number, F.col("_metadata.row_index")))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = Scratch(spark).keep(docs, f"stage-{name}")
    return docs
