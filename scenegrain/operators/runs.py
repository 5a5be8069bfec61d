"""Masks as runs of pixels: (frame_id, mask_id, start, stop), half open, in row-major order of an image of known width.

Nothing here unfolds pixels: overlaps, boolean algebra and resizing work on the ends of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs_of_rects(rects: DataFrame, width: int) -> DataFrame:
    """Runs of rectangles (frame_id, mask_id, x0, y0, x1, y1; right and bottom exclusive), one a row; empty ones have none."""
    some = rects.where("x0 < x1 AND y0 < y1").withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    return some.select("frame_id", "mask_id", *((F.col("y") * width + F.col(x)).cast("long").alias(n) for x, n in (("x0", "start"), ("x1", "stop"))))


def runs_of_lengths(masks: DataFrame, lengths: str = "lengths") -> DataFrame:
    """Runs of run-length arrays, which begin with a number of pixels outside; zero lengths make no run."""
    ends = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda t, n: F.array_append(t, F.element_at(t, -1) + n))
    m = masks.select("frame_id", "mask_id", F.posexplode(ends).alias("i", "start"), ends.alias("ends"))
    return m.where("i % 2 = 1").select("frame_id", "mask_id", "start", F.get("ends", F.col("i") + 1).alias("stop")).where("start < stop")


def merged(runs: DataFrame, *keys: str) -> DataFrame:
    """keys, start, stop: runs of equal keys that meet or overlap become one; so the union of masks, with keys without mask_id.

    Empty runs and those with a null end do nothing. One window holds the runs of one key, which one image bounds.
    """
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    far = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = runs.where("start < stop").select(*keys, "start", "stop").withColumn("new", (far.isNull() | (far < F.col("start"))).cast("int"))
    d = d.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def areas(runs: DataFrame) -> DataFrame:
    """frame_id, mask_id, area: pixels of each mask, those of overlapping runs once."""
    return merged(runs, "frame_id", "mask_id").groupBy("frame_id", "mask_id").agg(F.sum(F.col("stop") - F.col("start")).alias("area"))


def tiled(runs: DataFrame, tile: int) -> DataFrame:
    """Runs cut at multiples of `tile` pixels, with the tile's number."""
    t = runs.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("stop") - 1) / tile))))
    return t.withColumn("start", F.greatest("start", F.col("tile") * tile)).withColumn("stop", F.least("stop", (F.col("tile") + 1) * tile))


def overlaps(a: DataFrame, b: DataFrame | None = None, tile: int = 4096) -> DataFrame:
    """frame_id, a, b, inter: pixels that mask a of one table shares with mask b of the other, where they share any; of one
    table alone, each pair once with a < b. Runs meet by frame and tile of the image, so no pair of masks is made that has no
    tile in common."""
    left = tiled(merged(a, "frame_id", "mask_id"), tile).select("frame_id", "tile", F.col("mask_id").alias("a"), F.col("start").alias("s"), F.col("stop").alias("e"))
    right = tiled(merged(a if b is None else b, "frame_id", "mask_id"), tile).withColumnRenamed("mask_id", "b")
    d = left.join(right, ["frame_id", "tile"]).where("s < stop AND start < e")
    d = d if b is not None else d.where("a < b")
    return d.groupBy("frame_id", "a", "b").agg(F.sum(F.least("e", "stop") - F.greatest("s", "start")).alias("inter"))


def iou(runs: DataFrame, tile: int = 4096) -> DataFrame:
    """frame_id, a, b, inter, iou of all pairs of a frame's masks that overlap."""
    n = areas(runs)
    na, nb = (n.select("frame_id", F.col("mask_id").alias(k), F.col("area").alias(f"n_{k}")) for k in "ab")
    d = overlaps(runs, tile=tile).join(na, ["frame_id", "a"]).join(nb, ["frame_id", "b"])
    return d.select("frame_id", "a", "b", "inter", (F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))).alias("iou"))


def swept(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """keys, start, stop, in_a, in_b: the stretches of pixels between any two ends of runs, and in which of the tables they
    are (in neither: a gap). Ends are swept in order, within a key."""
    long = [F.lit(v).cast("long") for v in (1, 0, 0, 1)]
    runs = a.select(*keys, "start", "stop", long[0].alias("da"), long[1].alias("db")).union(b.select(*keys, "start", "stop", long[2], long[3]))
    # A run counts up at its start and down at its end, however many of its table overlap there.
    both = F.explode(F.array(F.struct(F.col("start").alias("at"), "da", "db"), F.struct(F.col("stop").alias("at"), (-F.col("da")).alias("da"), (-F.col("db")).alias("db"))))
    steps = runs.where("start < stop").select(*keys, both.alias("e")).select(*keys, "e.*").groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(*keys).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = steps.select(*keys, F.col("at").alias("start"), F.lead("at").over(w).alias("stop"), (F.sum("da").over(so_far) > 0).alias("in_a"), (F.sum("db").over(so_far) > 0).alias("in_b"))
    return d.where(F.col("stop").isNotNull())


def combined(a: DataFrame, b: DataFrame, keep: Column, *keys: str) -> DataFrame:
    """keys, start, stop: pixels for which `keep` holds, a condition on the booleans in_a and in_b (F.col("in_a") & ~F.col("in_b")
    is the difference). It must be false where both are."""
    return merged(swept(a, b, *keys).where(keep), *keys)


def resized(runs: DataFrame, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize between images of (width, height): every target pixel takes its source pixel, from above."""
    (w, h), (w2, h2) = src, dst
    row = F.explode(F.sequence(F.floor(F.col("start") / w), F.floor((F.col("stop") - 1) / w)))
    d = merged(runs, "frame_id", "mask_id").withColumn("y", row)
    x0, x1 = F.greatest("start", F.col("y") * w) - F.col("y") * w, F.least("stop", (F.col("y") + 1) * w) - F.col("y") * w
    up = lambda v, to, of: F.ceil(v * to / of)
    d = d.select("frame_id", "mask_id", up(x0, w2, w).alias("s"), up(x1, w2, w).alias("e"), up(F.col("y"), h2, h).alias("y0"), (up(F.col("y") + 1, h2, h) - 1).alias("y1"))
    d = d.where("s < e AND y0 <= y1").withColumn("y", F.explode(F.sequence("y0", "y1")))
    return merged(d.select("frame_id", "mask_id", (F.col("y") * w2 + F.col("s")).alias("start"), (F.col("y") * w2 + F.col("e")).alias("stop")), "frame_id", "mask_id")
