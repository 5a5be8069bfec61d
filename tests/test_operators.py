import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from scenegrain.functions import models
from scenegrain.functions import scalar as s
from scenegrain.operators import blocks
from scenegrain.operators import cluster as c
from scenegrain.operators import crops
from scenegrain.operators import geometry as g
from scenegrain.operators import graph as gr
from scenegrain.operators import polygons as pg
from scenegrain.operators import segments as sg
from scenegrain.sources import formats as fm
from scenegrain.streaming import accumulate


def test_dense_ids(spark):
    for void, ids, want in ((-1, [-1, -1, 0, 3, 4, 0, 6], [-1, -1, 0, 1, 2, 0, 3]), (-1, [-1, -1], [-1, -1])):
        df = spark.createDataFrame(list(enumerate(ids)), "i int, k long")
        assert [r.dense_id for r in gr.dense_ids(df, "k", void=void).orderBy("i").collect()] == want


def test_scalars(spark):
    one = spark.range(1)
    v = one.select(s.morton(F.lit(1), F.lit(0), F.lit(0), 1), s.morton(F.lit(0), F.lit(1), F.lit(0), 1), s.morton(F.lit(1), F.lit(1), F.lit(1), 1), s.pixel(F.lit(1.5), F.lit(1.0), F.lit(1.0), F.lit(0.0)), s.pixel(F.lit(2.5), F.lit(1.0), F.lit(1.0), F.lit(0.0)), s.normalize_color(F.lit(127.5)), s.with_suffix(F.lit("lamp.")), s.remap_similarity(F.lit(-0.2), 0.5)).first()
    assert list(v) == [1, 2, 7, 2, 2, 0.0, "lamp.", 1.0]
    lists = one.select(s.clean_list(F.expr("array(null, ' ', '12', 'a', 'chair')")).alias("a"), s.clean_list(F.expr("array('')")).alias("b"), s.drop_stop_words(F.expr("array('box', 'lamp', 'background')")).alias("c"), s.chunked(F.sequence(F.lit(1), F.lit(7))).alias("d")).first()
    assert (lists.a, lists.b, lists.c, lists.d) == (["chair"], ["floor"], ["lamp"], [[1, 2, 3, 4, 5], [6, 7]])
    h = 14695981039346656037
    for x in (123456789, 5):
        h = ((h * 1099511628211) % 2**64) ^ x
    assert int(one.select(s.fnv_key([F.lit(123456789), F.lit(5)]).alias("k")).first().k) == h
    m = np.array(s.rotation((0, 0, 2), np.pi / 2))
    assert np.allclose(m @ [1, 0, 0], [0, 1, 0])


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.6), (5, 6, float("nan")), (7, 8, 1e-3), (9, 9, 1.0)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "id long")
    got = {r.id: r.cluster for r in gr.merge_by_threshold(nodes, e, 0.0).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    hac = {r.id: r.cluster for r in gr.single_linkage(nodes, e, 0.3).collect()}
    assert hac[1] == hac[2] == 1 and hac[3] == 3
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert gr.connected_components(path).select("component").distinct().count() == 1


def test_cluster_invariants(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(40, 3))
    i, d = c.fps_order(x, 10)
    assert len(set(i)) == 10 and (np.diff(d[1:]) <= 1e-12).all() and len(c.fps_order(x, 99)[0]) == 40
    plan = c.sinkhorn(r.normal(size=(5, 7)), np.full(5, 0.2), np.full(7, 1 / 7), 0.5, 1e-9, 500)
    assert np.allclose(plan.sum(1), 0.2, atol=1e-3) and np.allclose(plan.sum(0), 1 / 7, atol=1e-3)
    e = [(0, a, b, 1.0) for k in (0, 10) for a in range(k, k + 6) for b in range(a + 1, k + 6)] + [(0, 5, 10, 0.01)]
    got = {r.id: r.cluster for r in c.spectral_clusters(spark.createDataFrame(e, "scene long, src long, dst long, w double"), "scene", 2).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]


def test_kmeans_balances_and_starts_at_the_rim():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(scale=0.05, size=(20, 3)) + m for m in ((0, 0, 0), (3, 0, 0), (0, 3, 0), (0, 0, 3), (3, 3, 0), (3, 0, 3))])
    label = c.weighted_kmeans(x, 6)
    assert sorted(np.bincount(label)) == [20] * 6 and all(len(set(label[k : k + 20])) == 1 for k in range(0, 120, 20))
    d = ((x - x.mean(0)) ** 2).sum(1)
    assert c.fps_order(x, 3, centre=True)[0][0] == d.argmax()
    assert len(set(c.weighted_kmeans(x - x.mean(0), 6, cosine=True))) > 1
    plan = c.sinkhorn(np.zeros((4, 3)))
    assert np.allclose(plan, 1 / 12, atol=1e-6)


def test_cluster_and_merge(spark):
    e = [(0, a, b, 1.0) for k in (0, 10, 20) for a in range(k, k + 6) for b in range(a + 1, k + 6)] + [(0, 5, 10, 0.6), (0, 15, 20, 0.01)]
    edges = spark.createDataFrame(e, "scene long, src long, dst long, w double")
    points = spark.createDataFrame([(i, i % 30) for i in range(60)], "point_id long, spt_id long")
    conf = spark.createDataFrame([(i, 0.5 if i < 15 else 4.0) for i in range(30)], "id long, conf double")
    labels, merged, scores = c.cluster_and_merge(points, edges, conf, "scene", 3, 0.5)
    of = {r.point_id: r.merged for r in merged.collect()}
    assert len({of[i] for i in range(6)}) == 1 and of[0] == of[10] != of[20] and of[7] is None and of[37] is None
    got = {r.merged: r.conf for r in scores.collect()}
    assert got[of[20]] == 1.0 and 0.5 < got[of[0]] <= 1.0
    assert labels.where("cluster IS NOT NULL").count() == 36
    of_points, conf_of = c.merge_segments(points, edges, conf, 0.5)
    of = {r.point_id: r.cluster for r in of_points.collect()}
    assert of[0] == of[15] == 0 and of[20] == 20 and of[7] == of[37] == 7
    assert {r.cluster: round(r.conf, 4) for r in conf_of.collect()}[7] == 0.5


def test_nearest_neighbours_of_a_few_and_bad_coordinates(spark):
    r = np.random.default_rng(5)
    x = np.concatenate((r.uniform(0, 1, (60, 3)), r.uniform(50, 90, (5, 3))))
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(100, None, 0.0, 0.0), (101, float("nan"), 0.0, 0.0), (102, 0.0, float("inf"), 0.0)]
    got = gr.nearest_neighbours(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 3, 0.2).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {(g.src, g.dst, g.rn) for g in got} == {(i, int(j), k + 1) for i in range(65) for k, j in enumerate(np.argsort(d[i])[:3])}


def test_occlusion_bounds(spark):
    v = spark.createDataFrame([(0, 1, 5, 5, 1.0), (0, 2, 5, 5, 1.1), (0, 3, 5, 5, 1.3)], "frame_id int, point_id long, u long, v long, pz double")
    d = g.render_depth(v)
    assert {r.point_id for r in g.unoccluded(v, d, 0.1 + 1e-9).collect()} == {1, 2}
    assert {r.point_id for r in g.visibility_mask(v, d).collect()} == {1}
    assert {r.point_id for r in g.z_buffer(v, 0.2).collect()} == {1, 2}


def test_formats(spark, tmp_path):
    v = np.array([[0, 0, 0, 1, 2, 3], [1, 0, 0, 4, 5, 6], [0, 1, 0, 7, 8, 9]], float)
    (tmp_path / "a.ply").write_bytes(fm.ply_bytes(v, np.array([[0, 1, 2]])))
    p, f = fm.read_ply(spark, str(tmp_path / "a.ply"))
    assert [tuple(r)[2:] for r in p.orderBy("point_id").collect()] == [tuple(x) for x in v] and tuple(f.first())[2:] == (0, 1, 2)
    depth = np.arange(6, dtype="<u2").reshape(2, 3) * 1000
    eye = np.eye(4, dtype="<f4").tobytes()
    z = zlib.compress(depth.tobytes())
    raw = struct.pack("<IQ4s", 4, 4, b"test") + eye * 4 + struct.pack("<iiIIIIfQ", 2, 1, 3, 2, 3, 2, 1000.0, 2)
    raw += (eye + struct.pack("<QQQQ", 2**63 + 1, 2, 3, len(z)) + b"jpg" + z) * 2
    (tmp_path / "a.sens").write_bytes(raw)
    s_ = fm.read_streams(spark, str(tmp_path / "a.sens"))
    assert s_.count() == 2 and int(s_.first().ts_color) == 2**63 + 1
    assert {(r.y, r.x): r.d for r in fm.depth_pixels(s_, skip=2).collect()} == {(i, j): float(3 * i + j) for i in range(2) for j in range(3)}
    assert fm.pose_lines(s_).first().text.split("\n")[0] == "1.000000 0.000000 0.000000 0.000000"
    (tmp_path / "pose").mkdir()
    for k in (10, 9):
        (tmp_path / "pose" / f"{k}.txt").write_text("1 0 0 0\n0 1 0 0\n0 0 1 0\n0 0 0 1\n")
    assert [(r.frame_id, r.m[0]) for r in fm.read_matrices(spark, str(tmp_path / "pose")).collect()] == [(9, 1.0), (10, 1.0)]
    (tmp_path / "s.json").write_text('{"segIndices": [4, 4, 7]}')
    (tmp_path / "g.json").write_text('{"segGroups": [{"id": 0, "label": "chair", "segments": [4]}, {"id": 1, "label": "wall", "segments": [4, 7]}]}')
    j = fm.read_segments(spark, str(tmp_path / "s.json")).join(fm.read_groups(spark, str(tmp_path / "g.json")), "seg_id")
    last = j.groupBy("point_id").agg(F.max_by("label", "place").alias("label"))
    assert {r.point_id: r.label for r in last.collect()} == {0: "wall", 1: "wall", 2: "wall"}
    rle = spark.createDataFrame([(1, [2, 3, 1, 0, 1])], "mask_id int, runs array<int>")
    assert {(r.y, r.x) for r in fm.run_length_pixels(rle, 3).collect()} == {(0, 2), (1, 0), (1, 1)}
    (tmp_path / "i.txt").write_text("axis = 1 0 0\nname = x\n")
    assert fm.read_info(spark, str(tmp_path / "i.txt")).count() == 2


def test_models_and_streaming(spark, tmp_path):
    df = spark.createDataFrame([("a big chair",), (None,)], "t string").select(models.apply("nouns", F.col("t")).alias("n"), models.apply("embed_text", F.col("t")).alias("v"))
    assert sorted(map(len, (r.n for r in df.collect()))) == [0, 1]
    spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "k int, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v double").parquet(str(tmp_path / "in"))
    q = accumulate.running_means(stream, "k", "v").writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.k: (r.n, r["mean"]) for r in spark.table("means").collect()} == {1: (2, 3.0), 2: (1, 5.0)}


def test_masks_and_polygons(spark):
    """Refining keeps the largest part and fills holes; the polygon of a mask, filled, is the refined mask."""
    ring = [(1, x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)] + [(1, 9, 9), (1, 9, 9)]
    r = np.random.default_rng(3)
    rows = ring + [(m, x, y) for m in range(2, 8) for x in range(9) for y in range(9) if r.random() < m / 9]
    px = spark.createDataFrame(rows + [(8, None, 1)], "mask_id int, x int, y int")
    refined = {tuple(t) for t in pg.refine_masks(px).collect()}
    assert {t for t in refined if t[0] == 1} == {(1, x, y) for x in range(5) for y in range(5)}
    assert {tuple(t) for t in pg.polygon_pixels(pg.mask_polygons(px)).collect()} == refined
    odd = spark.createDataFrame([(1, [], []), (2, None, None), (3, [4], [5]), (4, [0, 4, None], [0, 0, 4])], "mask_id int, xs array<int>, ys array<int>")
    assert {tuple(t) for t in pg.polygon_pixels(odd).collect()} == {(3, 4, 5), *((4, x, 0) for x in range(5))}


def test_affine(spark):
    m = np.array(g.random_affine(0.5, 7, scale=(1.0, 1.0)))
    assert np.allclose(m @ m.T, np.eye(3) * 4) and np.allclose(m, g.random_affine(0.5, 7, scale=(1.0, 1.0)))
    p = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    assert list(g.transformed(p, [[0, -1, 0, 5], [1, 0, 0, 0], [0, 0, 2, 1]]).first()) == [3.0, 1.0, 7.0]


def test_list_frames(spark, tmp_path):
    for n in ("10.jpg", "2.jpg", "frame-7.png", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.number for r in fm.list_frames(spark, str(tmp_path)).orderBy("number").collect()] == [2, 7, 10]


def test_blocks_make_all_pairs_once(spark):
    a, b = spark.range(7).withColumnRenamed("id", "a"), spark.range(25).withColumnRenamed("id", "b")
    for most in (4, 10_000):
        got = [tuple(r) for r in blocks.with_each(a, b, "b", most).collect()]
        assert sorted(got) == [(i, j) for i in range(7) for j in range(25)]


def png16(image, kinds):
    """A 16-bit grey PNG whose line y is filtered by kinds[y]."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines, up = b"", [0] * (2 * image.shape[1])
    for kind, row in zip(kinds, image):
        raw = list(row.astype(">u2").tobytes())
        out = []
        for x, v in enumerate(raw):
            left, corner = (raw[x - 2], up[x - 2]) if x > 1 else (0, 0)
            p = left + up[x] - corner
            paeth = min((left, up[x], corner), key=lambda q: abs(p - q))
            out.append((v - (0, left, up[x], (left + up[x]) // 2, paeth)[kind]) % 256)
        lines, up = lines + bytes([kind, *out]), raw
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_depth_images(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 65536, (10, 7))
    (tmp_path / "3.png").write_bytes(png16(image, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]))
    d = fm.read_depth_images(spark, str(tmp_path))
    r = d.first()
    assert (r.width, r.height) == (7, 10) and np.allclose(np.array(r.depth).reshape(10, 7), image / 1000)
    assert fm.resize_depth(d, 7, 10).first().depth == r.depth
    for w, h in ((14, 5), (3, 20)):
        got = np.array(fm.resize_depth(d, w, h).first().depth).reshape(h, w)
        at = lambda n, src: np.clip((np.arange(n) + 0.5) * src / n - 0.5, 0, src - 1)
        rows = np.array([np.interp(at(w, 7), np.arange(7), row) for row in image / 1000])
        want = np.array([np.interp(at(h, 10), np.arange(10), col) for col in rows.T]).T
        assert np.allclose(got, want)
    for raw in (b"no image", png16(image, [0] * 10)[:20]):
        try:
            fm.png_gray16(raw)
            raise AssertionError("read")
        except (ValueError, struct.error):
            pass


def test_images_masks_scenes_and_meshes(spark, tmp_path):
    for scene in ("scene_b", "scene_a"):
        (tmp_path / "scans" / scene).mkdir(parents=True)
        (tmp_path / "scans" / scene / "x.txt").write_text("x")
    assert [r.scene_id for r in fm.list_scenes(spark, str(tmp_path / "scans")).collect()] == ["scene_a", "scene_b"]
    m = spark.createDataFrame([("train", "a", 0, 1, [0, 2]), ("train", "b", 1, 1, [1, 3]), ("val", "a", 0, 2, [4])], "split string, scene_id string, frame_id long, mask_id long, runs array<int>")
    fm.write_masks(m, str(tmp_path / "masks"))
    fm.write_masks(m.where("scene_id = 'b'").withColumn("mask_id", F.lit(9)), str(tmp_path / "masks"))
    assert [r.mask_id for r in fm.read_masks(spark, str(tmp_path / "masks"), "train", "b", 1).collect()] == [9]
    assert fm.read_masks(spark, str(tmp_path / "masks"), "train", "a").count() == 1
    p = spark.createDataFrame([("s", i, i / 2, 0.0, 1.0, 1, 2, 3) for i in range(5)], "scene_id string, point_id long, x double, y double, z double, red int, green int, blue int")
    fm.write_ply(p, str(tmp_path / "ply"))
    files = list((tmp_path / "ply" / "scene_id=s").glob("*.txt"))
    v, names, _ = fm.ply_tables(files[0].read_bytes())
    assert len(files) == 1 and names == ["x", "y", "z", "red", "green", "blue"] and v[3].tolist() == [1.5, 0, 1, 1, 2, 3]
    try:
        fm.ply_tables(b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n\0\0\0\0")
        raise AssertionError("read")
    except ValueError:
        pass


def test_crops_are_the_boxes_of_large_masks(spark):
    w, h = 12, 9
    data = np.arange(w * h * 3, dtype=np.uint8).reshape(h, w, 3)
    images = spark.createDataFrame([(1, w, 3, bytearray(data.tobytes()))], "frame_id long, width int, channels int, data binary")
    px = [(1, 1, x, y) for x in range(2, 10) for y in range(1, 6)] + [(1, 2, 0, 0)] + [(2, 3, x, y) for x in range(8) for y in range(8)]
    pixels = spark.createDataFrame(px, "frame_id long, mask_id long, x long, y long")
    got = crops.crop_features(images, pixels).collect()
    assert [(r.mask_id, r.area) for r in got] == [(1, 40)]
    assert np.allclose(got[0].feat, models.hashed_vector(data[1:6, 2:10].tobytes().hex()))


def test_weights_first_matches_and_uncovered_items(spark):
    m = spark.createDataFrame([(g, p) for g, ps in {1: [1, 2, 3], 2: [2, 3, 3], 3: [9], None: [1]}.items() for p in ps] + [(1, None)], "g long, p long")
    w = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 2.0)], "p long, weight double")
    got = {(r.i, r.j): (r.inter, round(r.precision, 3), round(r.recall, 3)) for r in sg.relation_matrix(m, "g", "p", w).collect()}
    assert got == {(1, 1): (3.5, 1.0, 1.0), (1, 2): (2.5, 1.0, 0.714), (2, 1): (2.5, 0.714, 1.0), (2, 2): (2.5, 1.0, 1.0)}
    v = spark.createDataFrame([(1, 5, 70), (1, 4, 80)], "k long, at long, value long")
    df = spark.createDataFrame([(1, 0), (2, 0)], "key long, _k long")
    assert [tuple(r) for r in sg.lookup(df, "key", v, "k", "value", -1, ["at"]).orderBy("key").collect()] == [(1, 0, 80), (2, 0, -1)]
    e = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 4.0]), (1, None), (2, [0.0, 0.0])], "k long, v array<double>")
    assert sorted((r.k, r.pos, round(r.val, 6)) for r in sg.mean_vectors(e, "k", "v").collect()) == [(1, 0, 0.6), (1, 1, 0.8), (2, 0, 0.0), (2, 1, 0.0)]
    runs = spark.createDataFrame([(1, [2, 3, 1, 0, 4, 1])], "mask_id long, runs array<int>")
    assert sorted((r.y, r.x) for r in fm.run_length_pixels(runs, 4).collect()) == [(0, 2), (0, 3), (1, 0), (2, 2)]
