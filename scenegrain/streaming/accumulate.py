"""A streaming view of per-key sums: the running features of points over arriving frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_means(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, total, n, mean of all rows so far: sums and counts merge, so update mode emits what has changed."""
    return stream.groupBy(key).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias("mean"))


def windowed_counts(stream: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Rows of each key and time window; rows later than `late` behind the newest are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
