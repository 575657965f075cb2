"""Sessions from text lines, CSV files, nested JSON and Parquet; schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import finite
from ..functions.text import array_field, numbers, scalar_field

#: Parallel arrays of a session line.
CHANNELS = ["timestamp", "heart_rate", "speed", "altitude", "latitude", "longitude"]


def session_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row a line: user, activity, sport, gender and the channel arrays of a dict-like text line.

    Elements that aren't numbers are left out; `aligned` says whether time and signal have equal lengths."""
    c = F.col(column)
    out = lines.select(
        "*", scalar_field(c, "userId").alias("user_id"), scalar_field(c, "id").alias("activity_id"),
        scalar_field(c, "sport").alias("sport"), scalar_field(c, "gender").alias("gender"),
        *[numbers(array_field(c, n)).alias(n) for n in CHANNELS])
    return out.withColumn("aligned", (F.size("timestamp") == F.size("heart_rate")) & (F.size("timestamp") > 0))


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    return session_lines(spark.read.text(path))


def read_session_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("secs", "km", "power", "hr", "cad", "alt")) -> DataFrame:
    """Rows of many session files, with the file they come from; cells that aren't finite numbers are null.

    Columns are matched by the header's names; a file may lack some."""
    schema = StructType.fromDDL(", ".join(f"{c} string" for c in columns))
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return raw.select(F.input_file_name().alias("file"), *[finite(F.col(c).try_cast("double")).alias(c) for c in columns])


def read_features_csv(spark: SparkSession, path: str, time: str = "secs", channels: tuple[str, ...] = ("hr", "alt", "km"), strict: bool = False) -> DataFrame:
    """(file, time, channels) of session files with a header.

    A row whose time is no finite number is dropped; a channel's bad cell is null, or with `strict` drops the row.  Files whose header lacks a
    column are an error: headers are compared before any row is read."""
    raw = spark.read.text(path, wholetext=True)  # a session's file is small
    lines = raw.select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    parsed = lines.select("file", F.split("value", "\r?\n").alias("rows")).withColumn(
        "names", F.transform(F.split(F.element_at("rows", 1), ","), lambda x: F.trim(x)))
    lacking = parsed.where(F.size(F.array_except(F.array(*[F.lit(c) for c in (time, *channels)]), "names")) > 0).select("file").limit(1).collect()
    if lacking:
        raise ValueError(f"missing required columns in {lacking[0].file}")
    cells = parsed.select("file", "names", F.posexplode(F.slice("rows", 2, F.size("rows")))).withColumn("cells", F.split("col", ","))
    value = lambda c: finite(F.get("cells", F.array_position("names", c).cast("int") - 1).try_cast("double"))
    out = cells.select("file", F.col("pos").alias("row"), *[value(c).alias(c) for c in (time, *channels)]).where(F.col(time).isNotNull())
    return out.dropna(subset=list(channels)) if strict else out


def read_rides(spark: SparkSession, path: str) -> DataFrame:
    """One row a ride of nested athlete files; files that can't be parsed have status `corrupt` and no ride."""
    schema = "ATHLETE struct<gender:string>, RIDES array<struct<date:string,sport:string,data:string>>, _corrupt string"
    raw = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").schema(schema).json(path)
    return raw.withColumn("file", F.input_file_name()).select(
        "file", F.when(F.col("_corrupt").isNotNull(), "corrupt").otherwise("ok").alias("status"),
        F.col("ATHLETE.gender").alias("gender"), F.posexplode_outer("RIDES").alias("ride_index", "ride")).select(
        "file", "status", "gender", "ride_index", "ride.*")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file under a folder; contents stay in the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
