"""Points and cameras: projection, visibility, masks, boxes, voxels and mesh normals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.functions.scalar import pixel, rotation
from scenegrain.operators.blocks import with_each


def in_camera(pairs: DataFrame) -> DataFrame:
    """Points beside their frames (as to_camera() describes them) in these frames' cameras: px, py, pz."""
    d = [F.col(c) - F.col("t")[i] for i, c in enumerate("xyz")]
    cam = [sum((F.col("rot")[3 * r + c] * d[r] for r in (1, 2)), F.col("rot")[c] * d[0]) for c in range(3)]
    return pairs.select("frame_id", "point_id", *(v.alias(n) for v, n in zip(cam, ("px", "py", "pz"))), "fx", "fy", "cx", "cy")


def to_camera(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Every point in every frame's camera. Frames (frame_id, r00..r22 by row as `rot`, `t`, fx, fy, cx, cy) are camera
    to world; the inverse of a rigid pose is its transpose. Frames are broadcast in blocks of bounded size."""
    return in_camera(with_each(points, frames, "frame_id"))


def pixels(c: DataFrame) -> DataFrame:
    """frame_id, point_id, u, v (pixel), pz of points in cameras."""
    return c.select("frame_id", "point_id", pixel(F.col("px"), F.col("fx"), F.col("pz"), F.col("cx")).alias("u"), pixel(F.col("py"), F.col("fy"), F.col("pz"), F.col("cy")).alias("v"), "pz")


def project(points: DataFrame, frames: DataFrame) -> DataFrame:
    """frame_id, point_id, u, v (pixel), pz (depth in the camera)."""
    return pixels(to_camera(points, frames))


def in_image(df: DataFrame, width: int, height: int, cut: int = 0) -> DataFrame:
    return df.where((F.col("u") >= cut) & (F.col("u") < width - cut) & (F.col("v") >= cut) & (F.col("v") < height - cut))


def in_front(df: DataFrame) -> DataFrame:
    return df.where("pz > 0")


def render_depth(projected: DataFrame) -> DataFrame:
    """depth(frame_id, v, u, d): the nearest point of each pixel."""
    return projected.groupBy("frame_id", "v", "u").agg(F.min("pz").alias("d"))


def unoccluded(projected: DataFrame, depth: DataFrame, tolerance: float = 0.1, relative: bool = False) -> DataFrame:
    limit = F.lit(tolerance) * F.col("d") if relative else F.lit(tolerance)
    return projected.join(depth, ["frame_id", "v", "u"]).where(F.abs(F.col("d") - F.col("pz")) <= limit).drop("d")


def z_buffer(projected: DataFrame, tolerance: float = 0.2) -> DataFrame:
    nearest = F.min("pz").over(Window.partitionBy("frame_id", "v", "u"))
    return projected.withColumn("near", nearest).where(F.col("pz") - F.col("near") <= tolerance).drop("near")


def visibility_mask(projected: DataFrame, depth: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Points that agree with a depth that is there (0 is none), strictly within the tolerance."""
    return projected.join(depth, ["frame_id", "v", "u"]).where((F.col("d") != 0) & (F.abs(F.col("pz") - F.col("d")) < tolerance)).drop("d")


def point_masks(visible: DataFrame, rects: DataFrame, tile: int = 64) -> DataFrame:
    """(frame_id, mask_id, point_id) of visible points in rectangular masks (x0 <= u < x1, y0 <= v < y1): both sides
    meet by image tile, so the join is by equality with a rest."""
    cover = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile))
    tiles = rects.withColumn("tx", F.explode(cover("x0", "x1"))).withColumn("ty", F.explode(cover("y0", "y1")))
    p = visible.withColumn("tx", F.floor(F.col("u") / tile)).withColumn("ty", F.floor(F.col("v") / tile))
    hit = p.join(tiles, ["frame_id", "tx", "ty"]).where("x0 <= u AND u < x1 AND y0 <= v AND v < y1")
    return hit.select("frame_id", "mask_id", "point_id")


def mask_pixels(rects: DataFrame) -> DataFrame:
    return rects.select("frame_id", "mask_id", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1").select("frame_id", "mask_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))


def resize_pixels(pixels: DataFrame, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize of long-form masks, (width, height): every target pixel looks up its source pixel."""
    cells = lambda c, k: (F.ceil(F.col(c) * dst[k] / src[k]), F.ceil((F.col(c) + 1) * dst[k] / src[k]))
    (x0, x1), (y0, y1) = cells("x", 0), cells("y", 1)
    some = pixels.where((x0 < x1) & (y0 < y1)).select("frame_id", "mask_id", F.explode(F.sequence(x0, x1 - 1)).alias("x2"), "y")
    return some.select("frame_id", "mask_id", F.col("x2").alias("x"), F.explode(F.sequence(y0, y1 - 1)).alias("y"))


def mask_boxes(pixels: DataFrame, least: int = 32) -> DataFrame:
    """Bounding box (right and bottom exclusive) of masks that have at least `least` pixels."""
    g = pixels.groupBy("frame_id", "mask_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count("*").alias("area"))
    return g.where(F.col("area") >= least)


def voxel(columns: list[Column], sizes: list[float]) -> list[Column]:
    return [F.floor(c / s).cast("long").alias(n) for c, s, n in zip(columns, sizes, ("vx", "vy", "vz"))]


def voxelize(points: DataFrame, sizes: list[float], order: list[str], label: str | None = None, ignore: int = 255) -> DataFrame:
    """One row per voxel: number of points, the first point by `order`, and with `label` that point's label or `ignore`
    where several points meet."""
    first = F.min(F.struct(*order, *([label] if label else []))).alias("first")
    g = points.groupBy(*voxel([F.col(c) for c in "xyz"], sizes)).agg(F.count("*").alias("n"), first)
    out = g.select("vx", "vy", "vz", "n", *(F.col(f"first.{c}").alias(c) for c in order), *([F.when(F.col("n") > 1, F.lit(ignore)).otherwise(F.col(f"first.{label}")).alias("voxel_label")] if label else []))
    return out


def voxel_inverse(points: DataFrame, sizes: list[float], order: list[str]) -> DataFrame:
    """Each point with the first point of its voxel."""
    v = points.withColumns(dict(zip(("vx", "vy", "vz"), voxel([F.col(c) for c in "xyz"], sizes))))
    first = v.groupBy("vx", "vy", "vz").agg(F.min(F.struct(*order)).alias("first"))
    return v.join(first, ["vx", "vy", "vz"])


def clip_box(points: DataFrame, half: float) -> DataFrame:
    """Points in the half-open box of that half side around the middle of the bounding box; all of them if none is."""
    mid = points.agg(*(((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in "xyz"))
    near = points.crossJoin(F.broadcast(mid)).withColumn("inside", F.expr(" AND ".join(f"{c} >= m{c} - {half}D AND {c} < m{c} + {half}D" for c in "xyz")))
    some = points.crossJoin(F.broadcast(mid)).agg(F.max(F.expr(" AND ".join(f"{c} >= m{c} - {half}D AND {c} < m{c} + {half}D" for c in "xyz"))).alias("some"))
    return near.crossJoin(F.broadcast(some)).where("inside OR NOT some").select(*points.columns)


def transformed(points: DataFrame, matrix: list[list[float]], prefix: str = "") -> DataFrame:
    """x, y, z (or normals, by prefix) after a 3 x 3 matrix and, in a fourth column, a shift."""
    c = [F.col(prefix + a) for a in "xyz"]
    rows = [sum((F.lit(float(m)) * v for m, v in zip(row[1:3], c[1:])), F.lit(float(row[0])) * c[0]) + F.lit(float(row[3]) if len(row) > 3 else 0.0) for row in matrix]
    return points.withColumns({prefix + a: r for a, r in zip("xyz", rows)})


def random_affine(voxel_size: float, seed: int, bounds: tuple[tuple[float, float], ...] = ((-np.pi / 64, np.pi / 64), (-np.pi / 64, np.pi / 64), (-np.pi, np.pi)), scale: tuple[float, float] = (0.9, 1.1)) -> list[list[float]]:
    """A seeded rotation about the axes, in an order drawn as well, times a scale over the size of a voxel."""
    r = np.random.default_rng(seed)
    turns = [np.array(rotation(tuple(np.eye(3)[k]), r.uniform(*b))) for k, b in enumerate(bounds)]
    out = np.eye(3)
    for k in r.permutation(3):
        out = out @ turns[k]
    return (out * r.uniform(*scale) / voxel_size).tolist()


def voxelize_affine(points: DataFrame, matrix: list[list[float]], order: list[str], half: float | None = None, label: str | None = None) -> DataFrame:
    """Clips (with `half`), transforms, cuts into unit voxels that start at 0, and takes the first point of each."""
    v = voxelize(transformed(points if half is None else clip_box(points, half), matrix), [1, 1, 1], order, label)
    low = v.agg(*(F.min(c).alias(f"lo_{c}") for c in ("vx", "vy", "vz")))
    return v.crossJoin(F.broadcast(low)).withColumns({c: F.col(c) - F.col(f"lo_{c}") for c in ("vx", "vy", "vz")}).drop(*low.columns)


def affine_voxel_map(points: DataFrame, matrix: list[list[float]], order: list[str], half: float | None = None) -> DataFrame:
    """The inverse map of voxelize_affine(): every point (after clipping) with its voxel, whose coordinates start at 0, and
    `first`, the struct of the `order` columns of the voxel's first point, by which other columns can be linked."""
    v = voxel_inverse(transformed(points if half is None else clip_box(points, half), matrix), [1, 1, 1], order)
    low = v.agg(*(F.min(c).alias(f"lo_{c}") for c in ("vx", "vy", "vz")))
    return v.crossJoin(F.broadcast(low)).withColumns({c: F.col(c) - F.col(f"lo_{c}") for c in ("vx", "vy", "vz")}).drop(*low.columns)


def ravel_key(points: DataFrame) -> DataFrame:
    """Adds `key`: mixed-radix number of integer coordinates vx, vy, vz after subtracting their minimum."""
    b = points.agg(*(F.min(c).alias(f"lo_{c}") for c in ("vx", "vy", "vz")), *(F.max(c).alias(f"hi_{c}") for c in ("vx", "vy", "vz")))
    d = points.crossJoin(F.broadcast(b))
    key = F.expr("((vx - lo_vx) * (hi_vy - lo_vy + 1) + (vy - lo_vy)) * (hi_vz - lo_vz + 1) + (vz - lo_vz)")
    return d.withColumn("key", key).drop(*b.columns)


def face_normals(faces: DataFrame, points: DataFrame) -> DataFrame:
    """face_id, v0..v2, unit normal nx, ny, nz and area of each face."""
    d = faces
    for k in range(3):
        d = d.join(points.select(F.col("point_id").alias(f"v{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz")), f"v{k}")
    e = {f"{c}{k}": F.col(f"{c}{k}") - F.col(f"{c}0") for c in "xyz" for k in (1, 2)}
    n = [e["y1"] * e["z2"] - e["z1"] * e["y2"], e["z1"] * e["x2"] - e["x1"] * e["z2"], e["x1"] * e["y2"] - e["y1"] * e["x2"]]
    d = d.select("face_id", "v0", "v1", "v2", *(c.alias(k) for c, k in zip(n, ("a", "b", "c")))).withColumn("len", F.sqrt(F.expr("a*a + b*b + c*c")) + 1e-8)
    return d.select("face_id", "v0", "v1", "v2", *((F.col(k) / F.col("len")).alias(m) for k, m in zip("abc", ("nx", "ny", "nz"))), (F.col("len") / 2).alias("area"))


def vertex_normals(faces: DataFrame, points: DataFrame) -> DataFrame:
    """Area-weighted mean of the normals of each vertex's faces, of unit length."""
    f = face_normals(faces, points).select(F.explode(F.array("v0", "v1", "v2")).alias("point_id"), *((F.col(c) * F.col("area")).alias(c) for c in ("nx", "ny", "nz")))
    g = f.groupBy("point_id").agg(*(F.sum(c).alias(c) for c in ("nx", "ny", "nz"))).withColumn("len", F.sqrt(F.expr("nx*nx + ny*ny + nz*nz")) + 1e-8)
    return g.select("point_id", *((F.col(c) / F.col("len")).alias(c) for c in ("nx", "ny", "nz")))
