"""Graphs of points that start from their cells: fewer products, the same vectors, no part of the graph lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrain.operators import kernel


def test_start_from_cells_finds_lone_parts_in_fewer_products(spark, monkeypatch):
    r = np.random.default_rng(1)
    xyz = r.normal(scale=0.125, size=(900, 3))
    xyz[:6] = [[2, 2, 2], [2.01, 2, 2], [2, 2, 2.01], [-3, 0, 0], [-3, 0.1, 0], [5, 5, 5]]  # parts of three and two points, one alone
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    a = kernel.dense(xyz, 0.2)
    linked = a.any(1)
    a = a[np.ix_(linked, linked)]
    s = 1 / np.sqrt(a.sum(1))
    want = np.linalg.eigvalsh(np.eye(len(a)) - s[:, None] * a * s)[:5]
    calls, seen, vectors, products = [], [], kernel.eigenvectors, kernel.products

    def spied(*args, **kw):
        calls.append(0)
        at = len(calls) - 1
        got = vectors(*args, **kw)
        seen.append((at, kw.get("begin"), calls[at], got[0]))
        return got

    def counted(*args, **kw):
        calls[-1] += 1
        return products(*args, **kw)

    monkeypatch.setattr(kernel, "eigenvectors", spied)
    monkeypatch.setattr(kernel, "products", counted)
    settings = {"iters": 2, "in_iters": 2, "tol": 1e-3}
    plain = {x.id: x.cluster for x in kernel.spectral_graph(df, 0.2, 5, **settings).collect()}
    fast = {x.id: x.cluster for x in kernel.spectral_graph(df, 0.2, 5, many=100, fine=2, **settings).collect()}
    (_, none, first, value), (_, _, _, _), (_, begin, second, again) = seen
    assert none is None and begin == "begin" and second < first
    assert value[0] == pytest.approx(want, abs=1e-5) and again[0] == pytest.approx(want, abs=1e-5)
    assert set(plain) == set(fast) == set(np.flatnonzero(linked).tolist())


@pytest.mark.parametrize("single, near", [(False, 1e-12), (True, 1e-4)])
def test_products_reach_no_further_than_they_must(spark, monkeypatch, single, near):
    """Squares of points near each other, so most pairs that are looked at are linked."""
    xyz = np.random.default_rng(2).normal(scale=0.3, size=(3000, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    state, blocks = kernel.in_blocks(df, None, 0.2, rows=1000)
    state = state.withColumn("root", F.transform("ids", lambda i: F.lit(1.0)))
    got = dict.fromkeys(range(3000), 0.0)
    rows = {r.block: r.ids for r in state.collect()}
    for r in kernel.products(state, blocks, 0.2, single=single).collect():
        for i, x in zip(rows[r.block], r.s):
            got[i] += x
    a = kernel.dense(xyz, 0.2)
    assert [got[i] for i in range(3000)] == pytest.approx(a.sum(1).tolist(), abs=near * a.sum(1).max())
    order = [i for b in sorted(rows) for i in rows[b]]
    p, looked = xyz[order], 0
    for i in range(0, 3000, 64):
        few = p[i : i + 64]
        gap = np.maximum(0, np.maximum(few.min(0) - p, p - few.max(0)))
        looked += len(few) * int(((gap * gap).sum(1) <= 0.04).sum())
    assert looked < 0.4 * 3000**2
