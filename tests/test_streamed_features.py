"""Vector features of points over arriving frames: equal to the whole, across restarts, with timers and late frames."""

import datetime as dt
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrain.streaming.features import run_available, running_features

SCHEMA = "scene string, point_id long, frame_id int, at timestamp, feat array<double>"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def place(spark):
    return spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + f"/stream-{uuid.uuid4().hex}"


def add(spark, place, rows):
    spark.createDataFrame([(s, p, f, None if m is None else START + dt.timedelta(minutes=m), v) for s, p, f, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")


def run(spark, place, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{place}/in")
    run_available(running_features(stream, ["scene", "point_id"], "feat", "at", **options), f"{place}/out", f"{place}/check", 120)
    return spark.read.schema("scene string, point_id long, feat array<double>, n_frames long, final boolean, batch int").parquet(f"{place}/out")


def expected(rows):
    sums = {}
    for s, p, _, m, v in rows:
        if s is not None and p is not None and m is not None:
            n, x = sums.get((s, p), (0, None))
            sums[s, p] = n + 1, x if v is None else np.asarray(v) if x is None else x + np.asarray(v)
    unit = lambda x: None if x is None else x / (np.sqrt((x * x).sum()) or 1.0)
    return {k: (n, unit(x)) for k, (n, x) in sums.items()}


def newest(out):
    best = out.groupBy("scene", "point_id").agg(F.max(F.struct("n_frames", "feat")).alias("b")).collect()
    return {(r.scene, r.point_id): (r.b.n_frames, r.b.feat) for r in best}


def equal(got, want):
    assert got.keys() == want.keys()
    for k, (n, x) in want.items():
        assert got[k][0] == n
        assert (got[k][1] is None) == (x is None) and (x is None or np.allclose(got[k][1], x, atol=1e-12))


def test_goes_on_after_a_restart(spark, place):
    r = np.random.default_rng(4)
    rows = [(f"s{i % 2}", int(r.integers(0, 6)), i, i % 7, r.normal(size=3).tolist() if i % 4 else None) for i in range(60)]
    odd = [("s0", 77, 1, 1, None), ("s0", 78, 1, 1, [0.0, 0.0, 0.0]), (None, 1, 1, 1, [1.0, 1.0, 1.0]), ("s0", None, 1, 1, [1.0, 1.0, 1.0]), ("s0", 1, 1, None, [1.0, 1.0, 1.0])]
    add(spark, place, rows[:35] + odd)
    equal(newest(run(spark, place)), expected(rows[:35] + odd))
    add(spark, place, rows[35:])
    equal(newest(run(spark, place)), expected(rows + odd))


def test_late_frames_are_dropped_and_old_points_end(spark, place):
    add(spark, place, [("a", 1, 0, 0, [3.0, 4.0])])
    run(spark, place, late="5 minutes", keep_ms=60_000)
    add(spark, place, [("b", 2, 1, 100, [1.0, 0.0])])
    run(spark, place, late="5 minutes", keep_ms=60_000)
    add(spark, place, [("a", 1, 2, 10, [1.0, 0.0]), ("b", 2, 3, 99, [0.0, 1.0])])
    out = run(spark, place, late="5 minutes", keep_ms=60_000)
    rows = sorted((x.scene, x.n_frames, x.final) for x in out.collect())
    assert rows == [("a", 1, False), ("a", 1, True), ("b", 1, False), ("b", 2, False)]
    assert [x.feat for x in out.where("final").collect()] == [[0.6, 0.8]]
