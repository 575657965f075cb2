"""Where intermediate tables live, and how documents are read.

Intermediate tables are written to the folder that the cluster names in
spark.checkpoint.dir (shared by driver and executors), so a lost executor costs one task
and never a lineage.  Only where that setting is missing and everything runs in one process, as in tests, a folder
of the driver's own is made and recorded in the session; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder shared by driver and executors."""
    key = "spark.checkpoint.dir"
    named = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"{key} must name a folder that the driver and all executors of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set(key, named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/cadenza/{uuid.uuid4().hex[:12]}-{name}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables on whatever file system holds them."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The intermediate tables of one operator call; drop() removes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes a table to the shared folder and returns it as read from there."""
        path = fresh_path(self.spark, name)
        df.write.option("compression", codec).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        remove(self.spark, *(self.paths.pop(n) for n in names if n in self.paths))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A set of ids is sent to every executor only up to this many rows (8 bytes each).
BROADCAST_IDS = 2_000_000


def rows_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct keys, written table).

    The ids are counted first: up to BROADCAST_IDS they are broadcast, so wide rows don't
    move; beyond that both sides are shuffled.  Either way the result is the same.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


#: Keys that hold over one row in HEAVY; there are fewer than HEAVY of them, so they can always be broadcast.
HEAVY = 4000
#: Rows of one key that any task can take.
LIGHT = 256


def keyed_join(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with keyed (a written table with one row a key; `size` counts the rows of the key, `total` all rows).

    Keys with over total / HEAVY rows are fewer than HEAVY and are broadcast, so their rows stay where they are; the
    others are shuffled, and no task gets more than total / HEAVY rows of a key.
    """
    bar = max(LIGHT, total // HEAVY)
    heavy = keyed.where(F.col(size) > bar)
    if heavy.isEmpty():
        return rows.join(keyed.drop(size), keys)
    hot = rows.join(F.broadcast(heavy.drop(size)), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return hot.unionByName(rest.join(keyed.where(F.col(size) <= bar).drop(size), keys))
