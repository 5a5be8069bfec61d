"""Frames that meet only the cells in their view, and radius joins with crowded cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrain.operators import geometry, graph, views

POINT = "point_id long, x double, y double, z double"
FRAME = "frame_id int, rot array<double>, t array<double>, fx double, fy double, cx double, cy double"


def turned(r):
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    return [float(v) for v in q.ravel()]


@pytest.fixture(scope="module")
def scene(spark):
    r = np.random.default_rng(5)
    xyz = np.vstack([r.uniform(-4, 4, (1500, 3)), r.normal(2, 0.05, (700, 3))])
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)]
    rows += [(9001, None, 0.0, 0.0), (9002, float("nan"), 0.0, 0.0), (9003, 0.0, float("inf"), 0.0), (5, *map(float, xyz[5]))]
    frames = [(k, turned(r), [float(v) for v in r.uniform(-3, 3, 3)], 500.0, 480.0, 319.5, 239.5) for k in range(24)]
    frames += [(24, [2 * v for v in turned(r)], [0.0, 0.0, -1.0], 500.0, 480.0, 100.0, 400.0), (25, None, [0.0] * 3, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, POINT).repartition(3), spark.createDataFrame(frames, FRAME)


@pytest.mark.parametrize(("cut", "bits"), [(0, 4), (10, 2), (-300, 3)])
def test_views_equal_all_pairs(scene, cut, bits):
    points, frames = scene
    every = geometry.in_front(geometry.in_image(geometry.project(graph.finite(points), frames), 640, 480, cut))
    got = sorted(map(tuple, views.project_in_view(points, frames, 640, 480, cut, bits).collect()))
    assert got and got == sorted(map(tuple, every.collect()))


def test_views_join_fewer_rows(scene):
    points, frames = scene
    shown = views.project_in_view(points, frames, 640, 480).count()
    joined = views.near_views(points, frames, 640, 480).count()
    blocks = views.near_views(points, frames, 640, 480, most=500)
    assert blocks.count() == joined and blocks.rdd.getNumPartitions() > points.rdd.getNumPartitions()
    assert shown <= joined < 0.35 * points.count() * frames.count()


@pytest.mark.parametrize("rows", [[], [(1, 0.0, 0.0, 3.0)], [(1, 0.0, 0.0, 3.0), (2, 1.0, 0.5, 3.0)], [(1, None, None, None)], [(1, 0.0, 0.0, 1e-9)]])
def test_views_of_few_points(spark, scene, rows):
    points = spark.createDataFrame(rows, POINT).withColumn("rot", F.lit(7)).withColumn("cell", F.lit("a"))
    frames = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0] * 3, 500.0, 500.0, 319.5, 239.5)] * 2, FRAME)
    want = [(1, i, round(x * 500 / max(z, 1e-6) + 319.5), round(y * 500 / max(z, 1e-6) + 239.5), z) for i, x, y, z in rows if x is not None] * 2
    assert sorted(map(tuple, views.project_in_view(points, frames, 640, 480).collect())) == sorted(want)
    assert views.project_in_view(points, frames.limit(0), 640, 480).count() == 0


def cloud(spark):
    r = np.random.default_rng(11)
    xyz = np.vstack([r.uniform(0, 1, (300, 3)), r.uniform(0.4, 0.5, (250, 3)), np.tile(r.uniform(0.4, 0.5, 3), (60, 1))])
    return xyz, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], POINT)


def pairs_of(xyz, r, n=None):
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    return {(i, j) for i, j in zip(*np.where(d < r)) if (i < j if n is None else i != j and i < n)}


@pytest.mark.parametrize("dense", [4096, 40, 10])
def test_radius_pairs_of_crowded_cells(spark, dense):
    xyz, points = cloud(spark)
    got = [(a, b) for a, b, _ in graph.radius_pairs(points, 0.1, dense=dense).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(xyz, 0.1)
    few = points.where("point_id < 330")
    got = [(a, b) for a, b, _ in graph.radius_pairs(few, 0.1, others=points, dense=dense).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(xyz, 0.1, 330)


def test_radius_keys_of_crowded_cells_are_bounded(spark):
    """A third of the points on one spot: no key of the join holds much more than `dense` rows of a side."""
    xyz = np.random.default_rng(2).uniform(0, 1, (2000, 3))
    points = spark.createDataFrame([(i, *map(float, p if i % 3 else (0.55, 0.55, 0.55))) for i, p in enumerate(xyz)], POINT)
    side = lambda i: points.select(F.col("point_id").alias("src" if i == "a" else "dst"), *(F.col(c).alias(c + i) for c in "xyz"), *(F.floor(F.col(c) / 0.1).alias("c" + c) for c in "xyz"))
    hot = side("b").groupBy("cx", "cy", "cz").count().where("count > 50").select("cx", "cy", "cz", F.lit(True).alias("hot"))
    around = side("a").withColumn("o", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("cx", F.col("cx") + F.col("o")).drop("o")
    a, b, keys = graph.split_cells(around, side("b"), hot, 1, 0.1, 50)
    assert max(x["count"] for d in (a, b) for x in d.groupBy(keys).count().collect()) <= 90
    assert hot.count() == 1 and a.groupBy(keys).count().count() > 14 * 14


def test_radius_pairs_of_odd_rows(spark):
    rows = [(1, 0.0, 0.0, 0.0), (1, 0.01, 0.0, 0.0), (2, -0.01, 0.0, 0.0), (2, -0.01, 0.0, 0.0), (None, 0.0, 0.0, 0.0), (3, None, 0.0, 0.0), (4, float("nan"), 0.0, 0.0), (5, 0.0, float("-inf"), 0.0)]
    points = spark.createDataFrame(rows, POINT)
    for dense in (1, 100):
        assert sorted((a, b) for a, b, _ in graph.radius_pairs(points, 0.1, dense=dense).collect()) == [(1, 2)] * 4
        assert graph.radius_pairs(points.limit(0), 0.1, dense=dense).count() == 0
    with pytest.raises(ValueError, match="radius"):
        graph.radius_pairs(points, 0.0)
