"""Streams by offset, the sink of named files, and nouns."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrain.functions import nouns
from scenegrain.sources import formats as fm
from scenegrain.sources import streams


def stream(n: int, seed: int = 0) -> bytes:
    r = np.random.default_rng(seed)
    m = [r.normal(size=16).astype("<f4").tobytes() for _ in range(4)]
    raw = struct.pack("<IQ4s", 4, 4, b"test") + b"".join(m) + struct.pack("<iiIIIIfQ", 2, 1, 3, 2, 3, 2, 1000.0, n)
    for i in range(n):
        z = zlib.compress(r.integers(0, 5000, 6).astype("<u2").tobytes())
        color = bytes(r.integers(0, 256, int(r.integers(0, 400)), dtype=np.uint8))
        raw += r.normal(size=16).astype("<f4").tobytes() + struct.pack("<QQQQ", 2**63 + i, i, len(color), len(z)) + color + z
    return raw


def test_streams_by_offset(spark, tmp_path):
    for k, n in enumerate((40, 0, 1)):
        (tmp_path / f"{k}.sens").write_bytes(stream(n, k))
    (tmp_path / "notes.txt").write_text("no stream")
    want = fm.read_streams(spark, f"{tmp_path}/*.sens").drop("path").collect()
    for size, parts in ((1, 41), (2000, None), (1 << 30, 2)):
        d = streams.read_stream_ranges(spark, f"file://{tmp_path}", size)
        assert parts is None and 4 < d.rdd.getNumPartitions() < 41 or d.rdd.getNumPartitions() == parts
        key = lambda r: (bytes(r.color), bytes(r.depth))
        assert sorted(d.drop("path").collect(), key=key) == sorted(want, key=key)
    (tmp_path / "0.sens").write_bytes(stream(40)[:-1])
    with pytest.raises(Exception, match="ends within"):
        streams.read_stream_ranges(spark, str(tmp_path)).collect()
    assert streams.read_stream_ranges(spark, f"{tmp_path}/1.sens").count() == 0
    with pytest.raises(ValueError, match="mounted"):
        streams.mounted("other://bucket/a.sens")


def test_depth_and_matrix_files_come_back(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(i, 4, 3, (r.integers(0, 65536, 12) / 1000).tolist(), r.normal(size=16).tolist()) for i in range(7)]
    d = spark.createDataFrame(rows, "frame_id long, width int, height int, depth array<double>, pose array<double>")
    png = d.select(F.format_string("depth/%d.png", "frame_id").alias("name"), streams.depth_png(F.col("width"), F.col("height"), F.col("depth")).alias("content"))
    streams.write_files(png, str(tmp_path / "out"))
    got = {int(x.path.split("/")[-1][:-4]): x for x in fm.read_depth_images(spark, str(tmp_path / "out")).collect()}
    assert {i: (got[i].width, got[i].height, got[i].depth) for i in got} == {i: (w, h, x) for i, w, h, x, _ in rows}
    streams.write_files(streams.matrix_files(d), str(tmp_path / "pose"))
    assert {x.frame_id: x.m for x in fm.read_matrices(spark, str(tmp_path / "pose")).collect()} == {r[0]: r[4] for r in rows}
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["depth"]  # nothing of the tasks is left
    with pytest.raises(Exception, match="0.txt|FileExists"):
        streams.write_files(streams.matrix_files(d), str(tmp_path / "pose"))
    streams.write_files(streams.matrix_files(d.limit(1)), str(tmp_path / "pose"), "overwrite")
    assert len(list((tmp_path / "pose").iterdir())) == 7
    for bad in ("../x", "/x", None, "_x"):
        with pytest.raises(Exception, match="no name"):
            streams.write_files(spark.createDataFrame([(bad, "x")], "name string, content string"), str(tmp_path / "bad"))
    streams.write_files(spark.createDataFrame([], "name string, content string"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())


def test_ply_files_of_eight_columns(spark, tmp_path):
    rows = [(f"s{i % 3}", 100 - i, i / 8, -i / 4, None if i == 5 else float(i), i, 2 * i, None, i % 4, i % 7) for i in range(60)]
    p = spark.createDataFrame(rows, "scene_id string, point_id long, x double, y double, z double, red int, green int, blue int, label int, instance int")
    streams.write_files(streams.ply_files(p.repartition(5), "label", "instance"), str(tmp_path / "ply"), order="part")
    for s in range(3):
        v, names, _ = fm.ply_tables((tmp_path / "ply" / f"s{s}.ply").read_bytes())
        assert names == ["x", "y", "z", "red", "green", "blue", "label", "instance"]
        own = sorted((x for x in rows if x[0] == f"s{s}"), key=lambda x: x[1])
        want = np.array([[np.nan if x[4] is None and k == 2 else x[2 + k] or 0 for k in range(8)] for x in own], float)
        assert np.array_equal(v, want, equal_nan=True)


def test_nouns(spark):
    rows = [(1, "USER [/INST] The boxes and two Shelves, a wooden bus near churches"), (2, None), (3, ""), (None, "Cities quickly glass chairs"), (1, "knives")]
    d = spark.createDataFrame([(i, k, t) for k, (i, t) in enumerate(rows)], "place long, k int, text string")
    got = {x.k: x.labels for x in nouns.noun_phrases(d, "text", "place", "k").collect()}
    assert got == {0: ["floor", "box", "two", "shelf", "wooden", "bus", "church"], 1: ["floor"], 2: ["floor"], 3: ["floor", "city", "glass", "chair"], 4: ["floor", "knife"]}
    lex = spark.createDataFrame([("two", "CD", None), ("wooden", "JJ", None), ("boxes", "NNS", "crate")], "word string, tag string, singular string")
    for most in (100, 1):
        clash = d.withColumn("word", F.lit("mine")).withColumn("_s", F.lit(0))
        t = nouns.tagged_words(clash, "text", lex, most).where("k = 0").orderBy("place_").collect()
        assert [x.noun for x in t if x.noun] == ["the", "crate", "and", "shelve", "a", "bus", "near", "church"] and t[0].word == "mine"
    assert nouns.tagged_words(d.limit(0), "text").count() == 0
