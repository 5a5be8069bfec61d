"""Runs of pixels against sets of pixels."""

import numpy as np
from pyspark.sql import functions as F

from scenegrain.operators import graph, runs, segments


def pixels(rows):
    out = {}
    for f, m, a, b in rows:
        if a is not None and b is not None and a < b:
            out.setdefault((f, m), set()).update(range(a, b))
    return out


def test_overlapping_and_odd_runs(spark):
    r = np.random.default_rng(4)
    rows = [(int(f), int(m), int(a), int(a + n)) for f, m, a, n in zip(r.integers(0, 2, 90), r.integers(0, 6, 90), r.integers(0, 300, 90), r.integers(0, 60, 90))]
    rows += [(0, 1, 50, 40), (0, 1, None, 9), (0, 1, 3, None), (1, 9, 5, 5), rows[0]]
    df = spark.createDataFrame(rows, "frame_id long, mask_id long, start long, stop long").withColumn("tile", F.lit("clash"))
    px = pixels(rows)
    assert {(a.frame_id, a.mask_id): a.area for a in runs.areas(df).collect()} == {k: len(v) for k, v in px.items()}
    want = {(f, a, b): (len(x & y), len(x & y) / len(x | y)) for (f, a), x in px.items() for (g, b), y in px.items() if f == g and a < b and x & y}
    for tile in (7, 4096):
        assert {(x.frame_id, x.a, x.b): (x.inter, x.iou) for x in runs.iou(df, tile).collect()} == want
    a, b = df.where("mask_id < 3"), df.where("mask_id >= 3")
    union = lambda f, ok: set().union(*(v for (g, m), v in px.items() if g == f and ok(m)))
    for keep, f in ((F.col("in_a") & F.col("in_b"), set.__and__), (F.col("in_a") & ~F.col("in_b"), set.__sub__), (F.col("in_a") | F.col("in_b"), set.__or__)):
        got = pixels([(x.frame_id, 0, x.start, x.stop) for x in runs.combined(a, b, keep, "frame_id").collect()])
        assert got == {(g, 0): f(union(g, lambda m: m < 3), union(g, lambda m: m >= 3)) for g in (0, 1)}
    assert runs.iou(df.limit(0)).count() == runs.combined(df.limit(0), df.limit(0), F.col("in_a"), "frame_id").count() == 0


def test_run_lengths(spark):
    df = spark.createDataFrame([(0, 1, [3, 2, 0, 4, 1]), (0, 2, [0, 5]), (0, 3, []), (0, 4, [9]), (0, 5, None)], "frame_id long, mask_id long, lengths array<int>")
    got = pixels([tuple(x) for x in runs.runs_of_lengths(df).collect()])
    assert got == {(0, 1): {3, 4, 5, 6, 7, 8}, (0, 2): {0, 1, 2, 3, 4}}


def test_helper_names_do_not_clash(spark):
    df = spark.createDataFrame([(7, 1.0, "a"), (3, 2.0, "b"), (7, 3.0, "c"), (-1, 0.0, "d"), (None, 0.0, "e")], "k long, e double, part string").withColumn("rank", F.lit(5))
    got = graph.dense_ids(df, "k").collect()
    assert sorted((x.k is None, x.k or 0, x.part, x.rank, x.dense_id) for x in got) == [(False, -1, "d", 5, -1), (False, 3, "b", 5, 0), (False, 7, "a", 5, 1), (False, 7, "c", 5, 1), (True, 0, "e", 5, None)]
    soft = segments.softmax(df.withColumn("p", F.lit("mine")), "k", "e", "share").where("k = 7").collect()
    assert {x.p for x in soft} == {"mine"} and abs(sum(x.share for x in soft) - 1) < 1e-12 and all(x.e in (1.0, 3.0) for x in soft)


def test_one_sweep_counts_all_of_an_algebra(spark):
    rows = [(0, 2, 0, 9), (0, 4, 5, 12), (0, 1, 8, 20), (0, 3, 8, 10), (1, 2, 3, 4), (2, 1, 0, 2), (2, 1, 1, 5), (2, 2, 5, 5), (2, 2, None, 3)]
    df = spark.createDataFrame(rows, "frame_id long, mask_id long, start long, stop long")
    d = runs.swept(df.where("mask_id % 2 = 0"), df.where("mask_id % 2 = 1"), "frame_id")
    got = {f: {k: set() for k in ("a", "b")} for f in range(3)}
    for x in d.collect():
        assert x.start < x.stop
        for k in "ab":
            got[x.frame_id][k] |= set(range(x.start, x.stop)) if x[f"in_{k}"] else set()
    assert got == {0: {"a": set(range(12)), "b": set(range(8, 20))}, 1: {"a": {3}, "b": set()}, 2: {"a": set(), "b": set(range(5))}}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") + plan.count("Window[") <= 2  # runs aren't made disjoint first
