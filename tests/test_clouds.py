"""Farthest points, transport and k-means over blocks against the versions for one array."""

import math
import os

import numpy as np
import pytest

from scenegrain.operators import clouds, cluster
from scenegrain.plans.registry import QUERIES, points

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(3000, 3)), 3)
    x[100:140] = x[5]
    rows = [(i, int(i >= 2400), *map(float, p), "clash") for i, p in enumerate(x)]
    odd = [(None, 0, 9.0, 9.0, 9.0, ""), (9001, None, 99.0, 9.0, 9.0, ""), (9002, 0, None, 0.0, 99.0, ""), (9003, 0, math.nan, 0.0, 0.0, ""), (9004, 0, math.inf, 0.0, 0.0, ""), (9005, 7, 1.0, 1.0, 1.0, "")]
    return x, spark.createDataFrame(rows + odd, "point_id long, g long, x double, y double, z double, block string").repartition(6).cache()


@pytest.mark.parametrize("centre", (False, True))
def test_farthest_points_of_blocks(cloud, centre):
    x, df = cloud
    for block, at_once in ((10**6, 64), (150, 2)):
        got = clouds.farthest_points(df, "g", 12, centre, block_points=block, at_once=at_once).orderBy("g", "rank").collect()
        for g, part, first in ((0, x[:2400], 0), (1, x[2400:], 2400)):
            i, d = cluster.fps_order(part, 12, centre)
            own = [r for r in got if r.g == g]
            assert [r["rank"] for r in own] == list(range(12)) and [r.point_id for r in own] == (i + first).tolist()
            assert [r.dist for r in own] == pytest.approx(np.where(np.isinf(d), 0, d).tolist(), rel=1e-12)
        assert [(r["rank"], r.point_id) for r in got if r.g == 7] == [(0, 9005)]
    assert clouds.farthest_points(df.limit(0), "g", 12).count() == 0


def test_farthest_points_of_equal_points_and_few(spark):
    df = spark.createDataFrame([(i, 0, 1.0, 1.0, 1.0) for i in (4, 2, 9)], "point_id long, g long, x double, y double, z double")
    got = clouds.farthest_points(df, "g", 5).orderBy("rank").collect()
    assert [(r.point_id, r.dist) for r in got] == [(2, 0.0)] * 3


def test_transport_of_rows(spark):
    r = np.random.default_rng(5)
    s = {g: r.normal(size=(n, m)) for g, n, m in ((0, 60, 7), (1, 25, 4))}
    rows = [(g, i * 3, j * 2, float(v), "x") for g, a in s.items() for (i, j), v in np.ndenumerate(a)]
    rows += [(0, 0, 0, -99.0, "x"), (0, None, 0, 1.0, "x"), (0, 3, None, 1.0, "x"), (None, 3, 2, 1.0, "x"), (1, 3, 2, None, "x"), (1, 3, 2, math.nan, "x")]
    df = spark.createDataFrame(rows, "g long, row long, col long, s double, at string").repartition(5)
    for thresh, rounds in ((0.0, 4), (1e9, 10)):
        got = clouds.transport(df, "g", thresh=thresh, n_iters=rounds).collect()
        assert len(got) == 60 * 7 + 25 * 4
        for g, a in s.items():
            plan = cluster.sinkhorn(a, thresh=thresh, n_iters=rounds)
            assert all(r.p == pytest.approx(plan[r.row // 3, r.col // 2], rel=1e-9, abs=1e-12) for r in got if r.g == g)
    for slack in (True, False):
        got = clouds.transport(df, "g", hard=True, n_iters=5, slack=slack).collect()
        for g, a in s.items():
            assert {r.row // 3: r.col // 2 for r in got if r.g == g} == dict(enumerate(cluster.sinkhorn_hard(a, 5, slack).tolist()))
    with pytest.raises(ValueError):
        clouds.transport(df, "g", most_columns=3)
    assert clouds.transport(df.limit(0), "g").count() == 0


@pytest.mark.parametrize("cosine", (False, True))
def test_balanced_kmeans_of_a_cloud(spark, cosine):
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(c, 0.1, size=(40 + 30 * i, 3)) for i, c in enumerate(((3, 0, 0), (0, 2, 0), (0, 0, 4), (1, 1, 1)))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "point_id long, x double, y double, z double").repartition(3)
    got = {r.point_id: r.cluster for r in clouds.balanced_kmeans(df, 4, iters=4, in_iters=3, cosine=cosine, block_points=90).collect()}
    assert [got[i] for i in range(len(x))] == cluster.weighted_kmeans(x, 4, iters=4, in_iters=3, cosine=cosine).tolist()
    assert clouds.balanced_kmeans(df.limit(0), 4).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_of_kmeans_over_the_whole_cloud(spark):
    rows = points(spark, SF).orderBy("point_id").collect()
    x = np.array([[r.x, r.y, r.z] for r in rows])
    got = {r.point_id: r.cluster for r in QUERIES["q_wkmeans"](spark, SF).collect()}
    assert [got[r.point_id] for r in rows] == cluster.weighted_kmeans(x, 6).tolist()
