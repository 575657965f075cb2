"""Last value in a window of time, as a stream: the twin of `last_in_bin`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_last(events: DataFrame, by: list[str], ts: str, value: str, tie: str, width: str, late: str) -> DataFrame:
    """(by, start, value, n): the last value in each window; rows later than `late` are dropped by the watermark.

    State is one row for each open (by, window), whatever the number of events."""
    win = F.window(ts, width)
    watermarked = events.withWatermark(ts, late) if events.isStreaming else events
    return watermarked.groupBy(*by, win.alias("w")).agg(
        F.max_by(value, F.struct(ts, tie)).alias("value"), F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "value", "n")
