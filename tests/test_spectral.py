"""Spectral clustering of edge tables against NumPy."""

import math

import numpy as np
import pytest

from scenegrain.operators import cluster, spectral


def graph(n, parts, seed, links):
    r = np.random.default_rng(seed)
    e = {}
    for _ in range(links):
        a, b = (int(x) for x in r.integers(0, n, 2))
        if a % parts != b % parts and r.random() > 0.02:
            b = (b // parts * parts + a % parts) % n
        if a != b:
            e[min(a, b), max(a, b)] = float(r.uniform(0.2, 1))
    return [(a, b, w) for (a, b), w in e.items()]


def dense(edges, n):
    a = np.zeros((n, n))
    for i, j, w in edges:
        a[i, j] = a[j, i] = w
    return a


def test_eigenvalues_of_500_nodes(spark):
    e = graph(500, 5, 1, 6000)
    odd = [(1, 1, 5.0), (None, 3, 1.0), (3, None, 1.0), (2, 900, None), (2, 901, math.nan), (2, 902, -1.0), (e[0][1], e[0][0], e[0][2] / 2)]
    value, v = spectral.eigenvectors(spark.createDataFrame(e + odd, "src long, dst long, w double"), 6)
    want, vectors = cluster.spectral_embedding(dense(e, 500), 5)
    assert value == pytest.approx(want[:6], abs=1e-6)
    got = np.array([[r[f"x{i}"] for i in range(6)] for r in v.orderBy("id").collect()])
    assert got.shape == (500, 6) and np.allclose(got.T @ got, np.eye(6), atol=1e-6)
    a = dense(e, 500)
    s = 1 / np.sqrt(a.sum(1))
    assert np.abs(s[:, None] * a * s @ got - got * (1 - value)).max() < 1e-4


def test_clusters_are_the_planted_parts_and_small_graphs_work(spark):
    e = graph(120, 3, 2, 2500)
    df = spark.createDataFrame(e, "src long, dst long, w double")
    got = {r.id: r.cluster for r in spectral.spectral_clusters(df, 3, tau=0.1, iters=6, in_iters=5).collect()}
    assert len(got) == 120 and all(len({got[i] for i in range(p, 120, 3)}) == 1 for p in range(3)) and len(set(got.values())) == 3
    tiny = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (8, 9, 0.5)], "src long, dst long, w double")
    value, v = spectral.eigenvectors(tiny, 9)
    want, _ = cluster.spectral_embedding(dense([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 0.5)], 5), 5)
    assert value == pytest.approx(want, abs=1e-6) and v.count() == 5
    assert spectral.spectral_clusters(tiny.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        spectral.spectral_clusters(tiny, 3, dst="other")


def test_cluster_and_merge_with_live_parameters(spark):
    e = [(a, b, 1.0) for k in (0, 10, 20) for a in range(k, k + 6) for b in range(a + 1, k + 6)] + [(5, 10, 0.6), (15, 20, 0.01)]
    edges = spark.createDataFrame(e, "src long, dst long, w double")
    points = spark.createDataFrame([(i, i % 30) for i in range(60)], "point_id long, spt_id long")
    conf = spark.createDataFrame([(i, 0.5 if i < 15 else 4.0) for i in range(30)], "id long, conf double")
    labels, merged, scores = spectral.cluster_and_merge(points, edges, conf, 3, 3, 0.1, 0.5, iters=4, in_iters=5)
    of = {r.point_id: r.merged for r in merged.collect()}
    assert len({of[i] for i in range(6)}) == 1 and of[0] == of[10] != of[20] and of[7] is None and of[37] is None
    assert {r.merged: r.conf for r in scores.collect()}[of[20]] == 1.0 and labels.where("cluster IS NOT NULL").count() == 36
