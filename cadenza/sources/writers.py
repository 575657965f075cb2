"""Sinks that are safe to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities as null."""
    return df.withColumns({n: finite(F.col(n)) for n, t in df.dtypes if t in ("double", "float")})


def write_table(df: DataFrame, path: str, by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Replaces a table; with `by`, only the partitions that df has."""
    writer = without_nan(df).write.format(fmt).mode("overwrite")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def append_unprocessed(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    """Adds the rows whose keys the table at path lacks, so an interrupted job can be started again."""
    from ..operators.audit import unprocessed

    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        df = unprocessed(df, spark.read.parquet(path), keys)
    df.write.mode("append").parquet(path)
