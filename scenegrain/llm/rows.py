"""Decisions about single rows, where ids may be null or repeat."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenegrain.operators.names import free_names
from scenegrain.sources.tables import save


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While tables are written from whole texts, Arrow batches have at most `rows` rows: they are held by both the JVM
    and the Python worker. The session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_hash(text: Column) -> Column:
    """A 64-bit number for the text; null texts have one of their own."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def numbered(rows: DataFrame, keys: list[str], name: str, salts: int = 64) -> DataFrame:
    """`rows` with `name`: 1, 2, ... within equal keys. A key with very many rows is dealt over `salts` groups."""
    salt, first, key = free_names(rows, "salt", "first", "key")
    d = save(rows.withColumn(salt, F.monotonically_increasing_id() % salts), "numbered")
    w = Window.partitionBy(*keys)
    sizes = d.groupBy(*keys, salt).count().withColumn(first, F.coalesce(F.sum("count").over(w.orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.select(F.struct(*keys, salt).alias(key), first)
    n = F.row_number().over(Window.partitionBy(*keys, salt).orderBy(*keys))
    return d.withColumn(name, n).join(sizes, F.struct(*keys, salt).eqNullSafe(F.col(key))).withColumn(name, F.col(name) + F.col(first)).select(*rows.columns, name)
