"""Projection without all pairs: frames meet the occupied cells of their view volume, and points join by cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.functions.scalar import morton
from scenegrain.operators.geometry import in_camera, in_front, in_image, pixels
from scenegrain.operators.graph import finite
from scenegrain.sources.tables import save

AXES = range(3)


def in_cells(points: DataFrame, bits: int = 5) -> tuple[DataFrame, DataFrame] | None:
    """Points (point_id, x, y, z) with the Morton code of their `cell`, and the occupied cells (cell, n, centre and half
    sides): the box around all points is cut into 2^bits parts a side, so there are at most 8^bits cells whatever the
    number of points. None if no point has finite coordinates."""
    p = finite(points).select("point_id", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    box = p.agg(*(F.min(c) for c in "xyz"), *(F.max(c) for c in "xyz")).first()
    if box[0] is None:
        return None
    parts, low = 1 << bits, box[:3]
    sides = [(high - c) / parts or 1.0 for c, high in zip(low, box[3:])]
    place = [F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col(c) - lo) / side))) for c, lo, side in zip("xyz", low, sides)]
    placed = p.withColumn("cell", morton(*place, bits))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), *(F.min(i).alias(f"i{k}") for k, i in enumerate(place)))
    centre = [(F.lit(lo) + (F.col(f"i{k}") + 0.5) * side).alias(f"m{k}") for k, (lo, side) in enumerate(zip(low, sides))]
    half = [F.lit(0.51 * side + 1e-12 * max(abs(lo), abs(high))).alias(f"h{k}") for k, (lo, high, side) in enumerate(zip(low, box[3:], sides))]
    return placed, cells.select("cell", "n", *centre, *half)


def inside(normal: list[Column | float]) -> Column:
    """Whether any part of a cell's box is on the inner side of the plane through the camera with that normal (in the
    camera's axes). It is never false for a box that holds a point of the image: pixels are rounded and depths near 0 are
    raised to 1e-6, which the last term allows for."""
    n = [c if isinstance(c, Column) else F.lit(float(c)) for c in normal]
    world = [sum((F.col("rot")[3 * r + k] * n[k] for k in (1, 2)), F.col("rot")[3 * r] * n[0]) for r in AXES]
    at = sum(((F.col(f"m{r}") - F.col("t")[r]) * world[r] for r in AXES), F.lit(0.0))
    reach = sum((F.col(f"h{r}") * F.abs(world[r]) for r in AXES), F.lit(0.0))
    return at + reach + F.abs(n[2]) * 1e-6 >= 0


def cells_in_view(cells: DataFrame, frames: DataFrame, width: int, height: int, cut: int = 0) -> DataFrame:
    """(frame_id, cell) of all cells that may hold points in front of the frame and inside its image less `cut`."""
    pairs = frames.crossJoin(F.broadcast(cells))  # cells are few: see in_cells()
    fx, fy, cx, cy = (F.col(c) for c in ("fx", "fy", "cx", "cy"))
    first, right, bottom = cut - 1, width - cut, height - cut  # a pixel more on every side
    planes = [[0, 0, 1], [fx, 0, cx - first], [-fx, 0, right - cx], [0, fy, cy - first], [0, -fy, bottom - cy]]
    return pairs.where(reduce(Column.__and__, map(inside, planes))).select("frame_id", "cell").distinct()  # of repeated frames


def near_views(points: DataFrame, frames: DataFrame, width: int, height: int, cut: int = 0, bits: int = 5, most: int = 500_000) -> DataFrame:
    """Points with the frames whose view volume meets their cell: all pairs that an image shows, and those of the cells
    at its border. Points are never shuffled: pairs of cells and frames are broadcast in blocks of about `most` rows,
    dealt by frame, with at most about 10,000 frames each, and points are read once a block."""
    found = in_cells(points, bits)
    few = frames.select("frame_id", "rot", "t", "fx", "fy", "cx", "cy")
    if found is None:
        return points.select("point_id", *(F.col(c).cast("double").alias(c) for c in "xyz")).limit(0).crossJoin(few)
    placed, cells = found
    few = save(few, "frames")
    pairs = save(cells_in_view(cells, few, width, height, cut), "views")
    blocks = max(1, -(-pairs.count() // most), -(-few.count() // 10_000))
    part = lambda df, b: F.broadcast(df.where(F.pmod(F.xxhash64("frame_id"), F.lit(blocks)) == b))
    return reduce(DataFrame.union, (placed.join(part(pairs, b), "cell").join(part(few, b), "frame_id").drop("cell") for b in range(blocks)))


def project_in_view(points: DataFrame, frames: DataFrame, width: int, height: int, cut: int = 0, bits: int = 5) -> DataFrame:
    """The rows of in_front(in_image(project(points, frames), width, height, cut)): frame_id, point_id, u, v, pz.

    Frames that look past a cell never meet its points. Points with a null or non-finite coordinate are in no view, nor
    are points in frames with a null pose or intrinsic; repeated points and frames give repeated rows; without points or
    frames there are no rows."""
    c = in_camera(near_views(points, frames, width, height, cut, bits))
    return in_front(in_image(pixels(c), width, height, cut))
