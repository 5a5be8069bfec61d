"""Work of superpoints and of the neighbours they start from: what goes through tasks, not only the result."""

import numpy as np
import pytest

from scenegrain.operators import graph, superpoints
from tests.test_superpoints import sequential


def cloud(spark, n, seed):
    xyz = np.random.default_rng(seed).normal(scale=0.125, size=(n, 3))
    return xyz, spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(xyz)], "point_id long, x double, y double, z double")


def test_thin_places_do_not_set_how_far_crowded_ones_look(spark, monkeypatch):
    """All pairs that are compared within the radii are a few times the pairs that are wanted, and in several tasks."""
    n, k, looked, plain = 3000, 20, [], graph.radius_pairs
    xyz, p = cloud(spark, n, 3)

    def counted(*args, **kw):
        pairs = plain(*args, **kw)
        looked.append((pairs.count(), pairs.rdd.getNumPartitions()))
        return pairs

    monkeypatch.setattr(graph, "radius_pairs", counted)
    near = graph.nearest_neighbours(p, k, 0.1).collect()
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert {(r.src, r.dst) for r in near} == {(i, int(j)) for i, row in enumerate(np.argsort(d, axis=1)[:, :k]) for j in row}
    assert sum(m for m, _ in looked) < 6 * n * k
    assert min(parts for _, parts in looked) >= 4


@pytest.mark.parametrize("smooth", [True, False])
def test_interleaved_segments_need_few_rounds(spark, monkeypatch, smooth):
    """Kinds of points that lie among each other, so segments reach through all blocks. With gaps between the kinds' weights
    only edges within a kind are in the first phase; without, the lightest edges settle what blocks leave."""
    n, seen, plain = 400, [], superpoints.rounds
    xyz, p = cloud(spark, n, 5)
    r = np.random.default_rng(6)
    kind = r.integers(4, size=n)
    near = np.argsort(((xyz[:, None] - xyz[None]) ** 2).sum(-1), axis=1)[:, 1:11]
    noise = r.uniform(0, 0.2 if smooth else 0.002, size=(n, 10)).round(5)
    edges = [(i, int(j), float(noise[i, m] + (0 if smooth else 0.3 * abs(kind[i] - kind[j])))) for i in range(n) for m, j in enumerate(near[i])]

    def spied(e, *args, **kw):
        changes, segments = plain(e, *args, **kw)
        seen.append((e.count(), len(changes)))
        return changes, segments

    monkeypatch.setattr(superpoints, "rounds", spied)
    got = superpoints.segment_graph(p, spark.createDataFrame(edges, "src long, dst long, w double"), 0.01, 5, 400).collect()
    assert {r.point_id: r.segment for r in got} == sequential(set(range(n)), edges, 0.01, 5)
    all_edges = len({(min(a, b), max(a, b)) for a, b, _ in edges})
    assert all_edges > 2000 and sum(m for _, m in seen) <= 14
    if not smooth:
        assert seen[0][0] < 0.4 * all_edges
