"""Every row of a table with every row of a smaller one that may still outgrow one broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrain.sources.tables import save


def with_each(df: DataFrame, few: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """All pairs of `df` with the rows of `few` (frames of a scene, classes), which are counted and broadcast in blocks of
    about `most` rows each, dealt by the hash of `key`; `df` is read once a block and never shuffled."""
    n = -(-few.count() // most)
    if n <= 1:
        return df.crossJoin(F.broadcast(few))
    few = save(few, "few")
    return reduce(DataFrame.union, (df.crossJoin(F.broadcast(few.where(F.pmod(F.xxhash64(key), F.lit(n)) == b))) for b in range(n)))
