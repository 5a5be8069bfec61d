"""Running features of points while frames arrive: a vector sum and a counter a point, kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scenegrain.operators.names import free_names

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PointFeatures(StatefulProcessor):
    """One point of a scene; `time` is a column of milliseconds. A timer `keep` milliseconds behind its newest frame ends it: the last row goes out and the
    state is freed."""

    def __init__(self, names: list[str], vec: str, time: str, keep: int) -> None:
        self.names, self.vec, self.time, self.keep = names, vec, time, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("features", "total array<double>, n long, newest long")

    def row(self, key: tuple, total: list[float] | None, n: int, final: bool) -> pd.DataFrame:
        """The mean over the frames that see the point, of unit length; a zero vector stays, no vector gives null."""
        feat = None
        if total is not None:
            mean = np.asarray(total, dtype=float) / n
            norm = float(np.sqrt((mean * mean).sum()))
            feat = (mean / norm if norm > 0 else mean).tolist()
        return pd.DataFrame([[*key, feat, n, final]], columns=[*self.names, "feat", "n_frames", "final"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, n, newest = self.state.get() if self.state.exists() else (None, 0, None)
        for batch in rows:
            vectors = [v for v in batch[self.vec] if v is not None]
            if vectors:
                total = np.sum([*([total] if total is not None else []), *vectors], axis=0, dtype=float).tolist()
            n += len(batch)
            at = int(batch[self.time].max())
            newest = at if newest is None else max(at, newest)
        self.state.update((total, n, newest))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(newest + self.keep)
        yield self.row(key, total, n, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            total, n, _ = self.state.get()
            self.state.clear()
            yield self.row(key, total, n, True)

    def close(self) -> None:
        pass


def running_features(stream: DataFrame, keys: list[str], vec: str, time: str, late: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """keys, feat (array<double>), n_frames, final: for each point that new frames see, the mean over all its frames of the
    summed features of the masks that cover it, of unit length.

    `stream` has a row for each frame and point that it sees: the sum of the features of the covering masks in `vec` (null
    where none covers it, which still counts as a frame) and the frame's `time`. Vectors of a point have one length and no
    null components; rows without a time or a key part are ignored. Rows more than `late` behind the newest are dropped by
    the watermark, which starts at 1970-01-01 00:00 UTC: frames up to that instant count as late. A point without frames
    for `keep_ms` goes out once more with `final` and leaves the state; if it comes back later it starts anew. Sums and
    counters are in RocksDB, so the number of points isn't bound by memory, and a query that is started again on its
    checkpoint goes on where it stopped. A row goes out for each point of a micro-batch: the one with the most frames holds.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # state of this kind needs it
    (ms,) = free_names(stream, "ms")
    rows = stream.select(*keys, vec, time, F.unix_millis(time).alias(ms)).dropna(subset=[*keys, time]).withWatermark(time, late)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", feat array<double>, n_frames long, final boolean"
    return rows.groupBy(*keys).transformWithStateInPandas(PointFeatures(keys, vec, ms, keep_ms), out, "Update", "EventTime")


def run_available(stream: DataFrame, path: str, checkpoint: str, seconds: int = 600) -> None:
    """Takes all that has arrived and stops. Each micro-batch has a folder of its own below `path`, written anew if the
    batch is repeated, so every row is there exactly once."""
    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    try:
        if not query.awaitTermination(seconds):
            raise TimeoutError(f"the stream didn't end within {seconds} s")
    finally:
        query.stop()
