"""Relations of groups with crowded items and heavy groups."""

from collections import Counter
from itertools import product

import numpy as np

from scenegrain.operators import segments


def test_blocks_of_items_and_parts_of_groups(spark):
    r = np.random.default_rng(2)
    rows = {(int(g), int(p)) for g, p in zip(r.integers(0, 40, 500), r.integers(0, 60, 500))} | {(g, 99) for g in range(40)} | {(7, p) for p in range(60)}
    df = spark.createDataFrame([*rows, (None, 3), (3, None), (7, 5)], "g long, p long")
    of = {}
    for g, p in rows:
        of.setdefault(p, []).append(g)
    want = Counter(pair for gs in of.values() for pair in product(gs, gs))
    size = Counter(g for g, _ in rows)
    weight = spark.createDataFrame([(p, p % 3) for p in range(60)], "p long, weight int")
    heavier = Counter()
    for p, gs in of.items():
        if p < 60:
            heavier.update({pair: p % 3 for pair in product(gs, gs)})
    for bounds in ({}, {"most": 6, "heavy": 9}):
        got = segments.relation_matrix(df, "g", "p", **bounds).collect()
        assert len(got) == len(want) and {(x.i, x.j): x.inter for x in got} == want
        assert all(abs(x.recall - x.inter / (size[x.i] + 1e-6)) < 1e-12 and abs(x.precision - x.inter / (size[x.j] + 1e-6)) < 1e-12 for x in got)
        got = segments.relation_matrix(df, "g", "p", weight, **bounds).collect()
        assert {(x.i, x.j): x.inter for x in got if x.inter} == {k: v for k, v in heavier.items() if v}
    plan = segments.relation_matrix(df, "g", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan  # pairs travel as lists


def test_groups_that_are_neighbours_get_an_items_list_once(spark):
    """Groups of ten next to each other share items; some groups are heavy, their blocks are cut out of runs."""
    r = np.random.default_rng(8)
    rows = {(10 * (p // 8) + int(g), p) for p in range(320) for g in r.choice(10, 6, replace=False)} | {(g, 400) for g in (3, 155, 156, 390)} | {(77, p) for p in range(40)}
    df = spark.createDataFrame([*rows], "g long, p long")
    of = {}
    for g, p in rows:
        of.setdefault(p, []).append(g)
    want = Counter(pair for gs in of.values() for pair in product(gs, gs))
    for bounds in ({}, {"pairs": 60}, {"pairs": 60, "most": 3}, {"pairs": 200, "heavy": 8}, {"pairs": 60, "heavy": 5, "most": 2}):
        got = segments.relation_matrix(df, "g", "p", **bounds).collect()
        assert len(got) == len(want) and {(x.i, x.j): x.inter for x in got} == want
    m = segments.relation_matrix(df, "g", "p", pairs=1e6)
    m.collect()
    sent = m._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(blk" in sent and "posexplode(js" not in sent  # a list goes to blocks, not to each group
    assert segments.relation_matrix(df.limit(0), "g", "p").count() == 0
