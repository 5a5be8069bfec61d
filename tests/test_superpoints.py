"""Superpoints against the sequential rule."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrain.operators import superpoints
from scenegrain.plans import iterative

SF = "/root/testdata/sf0.001"


def sequential(ids, edges, k, least):
    best = {}
    for a, b, w in edges:
        if a is None or b is None or w is None or math.isnan(w) or a == b or a not in ids or b not in ids:
            continue
        pair = min(a, b), max(a, b)
        best[pair] = min(w, best.get(pair, math.inf))
    order = sorted((w, a, b) for (a, b), w in best.items())
    parent, size, limit = {i: i for i in ids}, dict.fromkeys(ids, 1), dict.fromkeys(ids, k)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b, w):
        a, b = min(a, b), max(a, b)
        parent[b] = a
        size[a] += size[b]
        limit[a] = w + k / size[a]

    for w, a, b in order:
        a, b = find(a), find(b)
        if a != b and w <= limit[a] and w <= limit[b]:
            join(a, b, w)
    for w, a, b in order:
        a, b = find(a), find(b)
        if a != b and (size[a] < least or size[b] < least):
            join(a, b, w)
    return {i: find(i) for i in ids}


def test_many_blocks_give_the_sequential_segments(spark):
    r = np.random.default_rng(8)
    n = 2000
    xyz = r.uniform(size=(n, 3))
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    near = np.argsort(d, axis=1)[:, 1:9]
    side = (xyz[:, 0] * 4).astype(int) + 4 * (xyz[:, 1] * 4).astype(int)
    tilt = r.normal(size=(16, 3))[side] + r.normal(scale=0.08, size=(n, 3))
    tilt /= np.linalg.norm(tilt, axis=1, keepdims=True)
    edges = [(i, int(j), round(float(1 - tilt[i] @ tilt[j]), 4)) for i in range(n) for j in near[i]]  # rounding makes ties
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(xyz)], "point_id long, x double, y double, z double")
    e = spark.createDataFrame(edges, "src long, dst long, w double")
    want = sequential(set(range(n)), edges, 0.01, 20)
    assert 10 < len(set(want.values())) < 400
    for block in (10**6, 1500):
        got = superpoints.segment_graph(p, e, 0.01, 20, block).collect()
        assert len(got) == n and {r.point_id: r.segment for r in got} == want


def test_a_chain_of_falling_weights_settles(spark):
    n = 14
    edges = [(i, i + 1, (n - i) / 1000) for i in range(n)]
    p = spark.createDataFrame([(i, float(i % 7), float(i % 5), 0.0) for i in range(n + 1)], "point_id long, x double, y double, z double")
    got = superpoints.segment_graph(p, spark.createDataFrame(edges, "src long, dst long, w double"), 0.05, 3, 6).collect()
    assert {r.point_id: r.segment for r in got} == sequential(set(range(n + 1)), edges, 0.05, 3)


def test_odd_edges_and_empty_tables(spark):
    rows = [(1, 0.0, 0.0, 0.0, "x"), (2, 1.0, 0.0, 0.0, "x"), (2, 1.0, 0.0, 0.0, "x"), (3, None, math.nan, 0.0, "x"), (9, 0.0, 0.0, 0.0, "x"), (None, 0.0, 0.0, 0.0, "x")]
    p = spark.createDataFrame(rows, "point_id long, x double, y double, z double, segment string")
    edges = [(2, 1, 0.005), (1, 2, 5.0), (3, 3, 0.0), (3, None, 0.0), (3, 1, math.nan), (3, 2, None), (3, 77, 0.0)]
    e = spark.createDataFrame(edges, "src long, dst long, w double")
    got = superpoints.segment_graph(p, e, 0.01, 20).collect()
    assert {r.point_id: r.segment for r in got} == {1: 1, 2: 1, 3: 3, 9: 9, None: None}
    assert superpoints.segment_graph(p.limit(0), e.limit(0)).count() == 0
    assert {r.segment for r in superpoints.segment_graph(p, e.limit(0)).collect()} == {1, 2, 3, 9, None}


def test_weights_of_normals(spark):
    point = lambda x, n: f"named_struct('x', {x}, 'y', 0D, 'z', 0D, 'nx', {n[0]}, 'ny', {n[1]}, 'nz', {n[2]})"
    a, flat, away, toward = point("0D", ("0D", "0D", "1D")), point("1D", ("0D", "0D", "1D")), point("1D", ("0.6D", "0D", "0.8D")), point("1D", ("-0.6D", "0D", "0.8D"))
    for b, want in ((flat, 0.0), (away, 0.04), (toward, 0.2)):
        row = spark.range(1).select(F.expr(a).alias("a"), F.expr(b).alias("b")).select(superpoints.normal_weight().alias("w")).first()
        assert row.w == pytest.approx(want, abs=1e-12)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_of_superpoints_against_the_sequential_rule(spark):
    rows = iterative.with_normals(spark, SF).orderBy("point_id").collect()
    at = np.array([[r.x, r.y, r.z] for r in rows])
    ids = [r.point_id for r in rows]
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    edges = []
    for i, row in enumerate(rows):
        for j in np.lexsort((ids, d[i]))[:50]:
            to = rows[j]
            w = 1.0 - (row.nx * to.nx + row.ny * to.ny + row.nz * to.nz)
            away = to.nx * (to.x - row.x) + to.ny * (to.y - row.y) + to.nz * (to.z - row.z)
            edges.append((row.point_id, to.point_id, w * w if away > 0 else w))
    want = sequential(set(ids), edges, 0.01, 20)
    assert {r.point_id: r.segment for r in iterative.q_superpoints(spark, SF).collect()} == want
