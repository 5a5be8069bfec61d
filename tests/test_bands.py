"""Eigenvalues by bands against NumPy, in memory and in files, and how groups are dealt to tasks."""

import numpy as np
import pytest

from scenegrain.operators import bands, kernel


@pytest.mark.parametrize("n, side, width", [(1, 16, 4), (2, 16, 4), (17, 8, 4), (37, 8, 4), (64, 16, 8), (203, 64, 16), (300, 128, 64)])
def test_values_of_bands(tmp_path, n, side, width):
    r = np.random.default_rng(n)
    a = r.normal(size=(n, n))
    for m in (a + a.T, np.kron(np.eye(n)[:, : (n + 1) // 2], np.ones((1, 2)))[:, :n] * np.eye(n), np.ones((n, n))):
        want = np.linalg.eigvalsh(m)
        strips, filed = [], bands.Filed(str(tmp_path))
        for i in range(0, n, side):
            strips.append(m[i:, i : i + side].copy())
            filed.append(strips[-1])
        for s in (strips, filed):
            got = bands.tridiagonal_values(*bands.to_tridiagonal(bands.to_band(s, width, chunk=10)))
            assert np.abs(got - want).max() < 1e-11


def test_groups_in_memory_and_in_files_have_tasks_of_their_own(spark):
    r = np.random.default_rng(4)
    xyz = r.normal(scale=0.1, size=(9000, 3))
    rows = [(i % 3, i, *map(float, p)) for i, p in enumerate(xyz[:6600])]
    df = spark.createDataFrame(rows, "label long, point_id long, x double, y double, z double")
    got = kernel.eigengaps(df, "label", 0.05, held=2100)  # 2200 points a group: files
    parts = got.select("label").rdd.mapPartitions(lambda rows: [{x.label for x in rows}]).collect()
    assert sorted(map(len, parts)) == [1, 1, 1]
    a = kernel.dense(xyz[:6600:3], 0.05)
    a = a[np.ix_(a.any(1), a.any(1))]
    s = 1 / np.sqrt(a.sum(1))
    want = np.linalg.eigvalsh(np.eye(len(a)) - s[:, None] * a * s)
    assert [x.value for x in got.where("label = 0").orderBy("rank").collect()] == pytest.approx(want, abs=1e-10)
