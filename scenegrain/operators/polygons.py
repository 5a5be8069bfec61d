"""Masks and polygons: filling polygons, refining masks to their largest part without holes, and outlines.

Filling is done with DataFrame functions. Refining and tracing see one mask at a time, which one image bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The eight neighbours as (dy, dx), clockwise on the screen from the left one.
AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def polygon_pixels(polygons: DataFrame, key: str = "mask_id") -> DataFrame:
    """(key, x, y): every whole pixel in or on the polygon of each row, by the even-odd rule.

    `polygons` has key, xs, ys: whole coordinates of the corners in order; the last joins the first. Rows without
    corners give no pixels; edges at a null corner are left out. One polygon a key.
    """
    n = F.size("xs")
    edge = lambda i: F.struct(F.col("xs")[i].alias("x0"), F.col("ys")[i].alias("y0"), F.col("xs")[(i + 1) % n].alias("x1"), F.col("ys")[(i + 1) % n].alias("y1"))
    e = polygons.where(n > 0).select(key, F.explode(F.transform(F.sequence(F.lit(0), n - 1), edge)).alias("e")).select(key, *(F.col(f"e.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))
    e = e.where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    cross = e.where("y0 <> y1").withColumn("y", F.explode(F.sequence(F.least("y0", "y1"), F.greatest("y0", "y1") - 1)))
    cross = cross.select(key, "y", ((F.col("x0") * (F.col("y1") - F.col("y0")) + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0"))) / (F.col("y1") - F.col("y0"))).alias("x"))
    pair = F.floor((F.row_number().over(Window.partitionBy(key, "y").orderBy("x")) - 1) / 2)
    spans = cross.withColumn("pair", pair).groupBy(key, "y", "pair").agg(F.ceil(F.min("x")).alias("a"), F.floor(F.max("x")).alias("b")).where("a <= b").select(key, "y", "a", "b")
    flat = e.where("y0 = y1").select(key, F.col("y0").alias("y"), F.least("x0", "x1").alias("a"), F.greatest("x0", "x1").alias("b"))
    corners = e.select(key, F.col("y0").alias("y"), F.col("x0").alias("a"), F.col("x0").alias("b"))
    all_ = spans.unionByName(flat).unionByName(corners)
    return all_.select(key, F.explode(F.sequence("a", "b")).alias("x"), "y").distinct()


def flood(free: np.ndarray, start: int, steps: np.ndarray) -> np.ndarray:
    """Flat mask of the free cells that can be reached; the cells at the rim must not be free."""
    seen = np.zeros(free.size, bool)
    front = np.array([start])
    seen[front] = True
    while len(front):
        front = (front[:, None] + steps).ravel()
        front = np.unique(front[free[front] & ~seen[front]])
        seen[front] = True
    return seen


def largest_part(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The part (joined by sides or corners) of the pixels with the largest area, its holes filled, as a grid, and the
    place of the grid's first cell. Of equal areas the part with the topmost, then leftmost pixel comes first."""
    left, top = int(x.min()) - 2, int(y.min()) - 2
    h, w = int(y.max()) - top + 3, int(x.max()) - left + 3
    todo = np.zeros((h, w), bool)
    todo[y - top, x - left] = True
    inner = np.zeros((h, w), bool)
    inner[1:-1, 1:-1] = True
    todo, inner = todo.ravel(), inner.ravel()
    eight = np.array([dy * w + dx for dy, dx in AROUND])
    best, area = None, -1
    for cell in np.flatnonzero(todo):
        if todo[cell]:
            part = flood(todo, cell, eight)
            todo &= ~part
            filled = inner & ~flood(inner & ~part, w + 1, eight[::2])
            if (n := int(filled.sum())) > area:
                best, area = filled, n
    return best.reshape(h, w), left, top


def outline(grid: np.ndarray) -> list[tuple[int, int]]:
    """(y, x) of the pixels at the outer edge of the one part in the grid, clockwise from its topmost, leftmost pixel."""
    start = tuple(int(v) for v in np.argwhere(grid)[0])
    at, back, out, first = start, 0, [start], None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            to = (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
            if grid[to]:
                break
        else:
            return out
        if first is None:
            first = (to, d)
        elif at == start and (to, d) == first:
            return out[:-1]
        # The search goes on from the neighbour that was looked at last, as seen from the new pixel.
        at, back = to, (d + 3 + (1 if d % 2 else 2)) % 8
        out.append(to)


def refine_masks(pixels: DataFrame, key: str = "mask_id") -> DataFrame:
    """(key, x, y): each mask's largest part with its holes filled; repeated pixels count once."""

    def refine(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, left, top = largest_part(pdf.x.to_numpy("int64"), pdf.y.to_numpy("int64"))
        y, x = np.nonzero(grid)
        return pd.DataFrame({key: pdf[key].iloc[0], "x": x + left, "y": y + top})

    p = pixels.where("x IS NOT NULL AND y IS NOT NULL").select(key, "x", "y")
    return p.groupBy(key).applyInPandas(refine, f"{key} {p.schema[key].dataType.simpleString()}, x long, y long")


def mask_polygons(pixels: DataFrame, key: str = "mask_id") -> DataFrame:
    """(key, xs, ys): the outline of each mask's largest part; polygon_pixels() of it gives that part, without holes."""

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, left, top = largest_part(pdf.x.to_numpy("int64"), pdf.y.to_numpy("int64"))
        line = outline(grid)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "xs": [[x + left for _, x in line]], "ys": [[y + top for y, _ in line]]})

    p = pixels.where("x IS NOT NULL AND y IS NOT NULL").select(key, "x", "y")
    return p.groupBy(key).applyInPandas(trace, f"{key} {p.schema[key].dataType.simpleString()}, xs array<long>, ys array<long>")
