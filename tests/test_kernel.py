"""Graphs of points within a radius, never written out, against NumPy and against their edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrain.operators import cluster, graph, kernel, spectral

BAD = [(0, 9001, math.nan, 0.0, 0.0), (0, None, 0.0, 0.0, 0.0), (None, 9002, 0.0, 0.0, 0.0), (0, 9003, 9.0, 9.0, 9.0), (1, 9004, None, 0.0, 0.0)]


def cloud(spark, n=120, seed=3):
    """Two groups of parts that stand apart, some points alone."""
    r = np.random.default_rng(seed)
    part = r.integers(0, 3, n)
    xyz = r.normal(scale=0.06, size=(n, 3)) + np.eye(3)[part] * 0.22
    rows = [(i % 2, i, *map(float, xyz[i])) for i in range(n)]
    return part, xyz, spark.createDataFrame(rows + BAD + rows[:2], "label long, point_id long, x double, y double, z double")


def edges_of(df, group=None):
    e = graph.radius_pairs(df.where("point_id IS NOT NULL").dropDuplicates(["point_id"]), 0.2).withColumn("w", F.exp(-F.col("d")))
    return e


def laplacian(xyz):
    d = np.sqrt(((xyz[:, None] - xyz) ** 2).sum(-1))
    a = np.where(d < 0.2, np.exp(-d), 0)
    np.fill_diagonal(a, 0)
    return a


def test_eigenvectors_of_blocks_equal_numpy_in_every_group(spark):
    _, xyz, df = cloud(spark)
    value, v = kernel.eigenvectors(df, 0.2, 5, "label", rows=40, tol=1e-6, degree=4)
    assert sorted(value) == [0, 1]
    for g in (0, 1):
        a = laplacian(xyz[g::2])
        some = a.any(1)
        a = a[np.ix_(some, some)]
        want, _ = cluster.spectral_embedding(a, 5)
        assert value[g] == pytest.approx(want[:5], abs=1e-8)
        got = v.where(F.col("g") == g).orderBy("id").collect()
        assert [r.id for r in got] == (np.arange(g, 120, 2)[some]).tolist()
        x = np.array([r.x for r in got])
        s = 1 / np.sqrt(a.sum(1))
        assert np.abs(s[:, None] * a * s @ x - x * (1 - value[g])).max() < 1e-5


def test_clusters_of_blocks_equal_those_of_one_task(spark):
    _, _, df = cloud(spark)
    one = {(r.label, r.id): r.cluster for r in kernel.spectral_clusters(df, "label", 0.2, 3).collect()}
    many = {(r.label, r.id): r.cluster for r in kernel.spectral_clusters(df, "label", 0.2, 3, max_nodes=20, rows=40, tol=1e-3).collect()}
    assert set(one) == set(many) and len({(k[0], one[k], many[k]) for k in one}) == 6
    assert kernel.spectral_clusters(df.limit(0), "label", 0.2, 3).count() == 0


def test_one_graph_and_its_edges(spark):
    _, _, df = cloud(spark)
    got = {r.id: r.cluster for r in kernel.spectral_graph(df, 0.2, 3, tau=0.1, iters=4, in_iters=4, rows=64, tol=1e-3).collect()}
    want = {r.id: r.cluster for r in spectral.spectral_clusters(edges_of(df), 3, tau=0.1, iters=4, in_iters=4, tol=1e-3).collect()}
    assert set(got) == set(want) and len({(got[i], want[i]) for i in got}) == 3
    assert kernel.spectral_graph(df.limit(0), 0.2, 3).count() == 0


def test_merged_clusters_equal_those_of_the_edges(spark):
    _, _, df = cloud(spark)
    p = df.where("point_id IS NOT NULL AND label IS NOT NULL").dropDuplicates(["point_id"])
    conf = p.select(F.col("point_id").alias("id"), (F.col("point_id") % 7 / 7.0).alias("conf"))
    e = edges_of(p).where("src % 2 = dst % 2").withColumn("scene", F.col("src") % 2)
    for t in (0.86,):
        want = cluster.cluster_and_merge(p.withColumn("spt_id", F.col("point_id")), e, conf, "scene", 3, t)[2]
        for most in (5000, 20):
            got = kernel.cluster_and_merge(p, conf, "label", 0.2, 3, t, max_nodes=most, **({} if most > 20 else {"tol": 1e-3}))[2]
            assert sorted(round(r.conf, 9) for r in got.collect()) == [pytest.approx(r.conf) for r in want.orderBy("conf").collect()]


def test_all_eigenvalues_and_the_bound_of_a_group(spark):
    _, xyz, df = cloud(spark)
    got = kernel.eigengaps(df, "label", 0.2).orderBy("label", "rank").collect()
    a = laplacian(xyz[::2])
    want, _ = cluster.spectral_embedding(a[np.ix_(a.any(1), a.any(1))], 1)
    assert [r.value for r in got if r.label == 0] == pytest.approx(want, abs=1e-9)
    with pytest.raises(Exception, match="takes 20"):
        kernel.eigengaps(df, "label", 0.2, max_nodes=20).collect()
