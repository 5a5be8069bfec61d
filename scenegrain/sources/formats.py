"""Scene formats: PLY meshes, sensor streams, segment and aggregation JSON, run-length masks, text matrices."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Property types of PLY headers, compression codes of sensor streams, and the stream version.
PLY_TYPES = {"char": "i1", "uchar": "u1", "int8": "i1", "uint8": "u1", "short": "i2", "ushort": "u2", "int16": "i2", "uint16": "u2", "int": "i4", "uint": "u4", "int32": "i4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
COLOR_CODES = {-1: "unknown", 0: "raw", 1: "png", 2: "jpeg"}
DEPTH_CODES = {-1: "unknown", 0: "raw_ushort", 1: "zlib_ushort", 2: "occi_ushort"}
STREAM_VERSION = 4


def ply_tables(raw: bytes) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(vertices, their property names, triangles) of an ASCII or little-endian PLY file; no vertices raise."""
    head, _, body = raw.partition(b"end_header\n")
    parts, ascii_ = [], b"format ascii" in head
    if b"format binary_big_endian" in head:
        raise ValueError("big-endian meshes aren't read")
    for line in head.decode().splitlines():
        w = line.split()
        if w[:1] == ["element"]:
            parts.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            parts[-1][2].append(w[1:])
    if not parts or parts[0][1] == 0:
        raise EOFError("the mesh has no vertices")
    name, n, props = parts[0]
    names, faces = [p[1] for p in props], np.zeros((0, 3), np.int64)
    n_faces = next((k for e, k, _ in parts if e == "face"), 0)
    if ascii_:
        lines = body.decode().split("\n")
        vertices = np.array([x.split() for x in lines[:n]], float)
        if n_faces:
            faces = np.array([x.split()[1:4] for x in lines[n : n + n_faces]], np.int64)
    else:
        row = np.dtype([(p[1], "<" + PLY_TYPES[p[0]]) for p in props])
        v = np.frombuffer(body, row, n)
        vertices = np.stack([v[c].astype(float) for c in names], 1)
        if n_faces:
            f = np.frombuffer(body, np.dtype([("k", "u1"), ("v", "<i4", 3)]), n_faces, n * row.itemsize)
            faces = f["v"].astype(np.int64)
    return vertices, names, faces


def ply_bytes(vertices: np.ndarray, faces: np.ndarray | None = None, with_label: bool = False) -> bytes:
    """ASCII PLY of vertices with 3, 6 or 7 columns: position, colour and, `with_label`, label."""
    kinds = ["float x", "float y", "float z", "uchar red", "uchar green", "uchar blue", "ushort label"][: vertices.shape[1]]
    if vertices.shape[1] not in (3, 6, 7) or with_label != (vertices.shape[1] == 7):
        raise ValueError("vertices have 3, 6 or, with labels, 7 columns")
    head = ["ply", "format ascii 1.0", f"element vertex {len(vertices)}", *(f"property {k}" for k in kinds)]
    if faces is not None:
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
    rows = [" ".join(f"{x:.6g}" if k.startswith("float") else str(int(x)) for k, x in zip(kinds, v)) for v in vertices]
    rows += [f"3 {a} {b} {c}" for a, b, c in (faces if faces is not None else [])]
    return ("\n".join([*head, "end_header", *rows]) + "\n").encode()


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, faces) of all PLY files under a path: one task reads a file, rows carry its path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def vertices(parts):
        for pdf in parts:
            for p, raw in zip(pdf.path, pdf.content):
                v, names, _ = ply_tables(raw)
                cols = {c: v[:, names.index(c)] if c in names else np.nan for c in ("x", "y", "z", "red", "green", "blue")}
                yield pd.DataFrame({"path": p, "point_id": np.arange(len(v)), **cols})

    def faces(parts):
        for pdf in parts:
            for p, raw in zip(pdf.path, pdf.content):
                f = ply_tables(raw)[2]
                yield pd.DataFrame({"path": p, "face_id": np.arange(len(f)), "v0": f[:, 0], "v1": f[:, 1], "v2": f[:, 2]})

    return files.mapInPandas(vertices, "path string, point_id long, x double, y double, z double, red double, green double, blue double"), files.mapInPandas(faces, "path string, face_id long, v0 long, v1 long, v2 long")


def stream_frames(raw: bytes) -> Iterator[dict]:
    """Header fields and payloads of each frame of a sensor stream; other versions raise."""
    at = 0

    def take(form: str):
        nonlocal at
        out = struct.unpack_from("<" + form, raw, at)
        at += struct.calcsize("<" + form)
        return out

    version, size = take("IQ")
    if version != STREAM_VERSION:
        raise ValueError(f"stream version {version}")
    sensor = take(f"{size}s")[0].decode()
    matrices = [list(take("16f")) for _ in range(4)]
    color, depth, cw, ch, dw, dh, shift, n = take("iiIIIIfQ")
    for i in range(n):
        pose = list(take("16f"))
        ts_color, ts_depth, n_color, n_depth = take("QQQQ")
        c, d = take(f"{n_color}s{n_depth}s")
        yield {"sensor": sensor, "frame_id": i, "pose": pose, "intrinsic_color": matrices[0], "extrinsic_color": matrices[1], "intrinsic_depth": matrices[2], "extrinsic_depth": matrices[3], "ts_color": ts_color, "ts_depth": ts_depth, "color_kind": COLOR_CODES[color], "depth_kind": DEPTH_CODES[depth], "depth_width": dw, "depth_height": dh, "depth_shift": shift, "color": c, "depth": d}


STREAM = "path string, sensor string, frame_id long, pose array<float>, intrinsic_color array<float>, extrinsic_color array<float>, intrinsic_depth array<float>, extrinsic_depth array<float>, ts_color decimal(20,0), ts_depth decimal(20,0), color_kind string, depth_kind string, depth_width int, depth_height int, depth_shift double, color binary, depth binary"


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """One row for each frame of all sensor streams under a path."""
    from decimal import Decimal

    def frames(parts):
        for pdf in parts:
            for p, raw in zip(pdf.path, pdf.content):
                for f in stream_frames(raw):
                    yield pd.DataFrame([{"path": p, **f, "ts_color": Decimal(f["ts_color"]), "ts_depth": Decimal(f["ts_depth"])}])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(frames, STREAM)


def depth_pixels(frames: DataFrame, scale: float = 1000.0, skip: int = 1) -> DataFrame:
    """frame_id, y, x, d of every `skip`-th frame: depths are zlib-compressed 16-bit integers, others raise."""

    @pandas_udf("array<int>")
    def decode(kind: pd.Series, raw: pd.Series) -> pd.Series:
        if not set(kind) <= {"zlib_ushort"}:
            raise ValueError(f"depth as {set(kind)}")
        return pd.Series([np.frombuffer(zlib.decompress(r), "<u2").astype(np.int32) for r in raw])

    f = frames.where(F.col("frame_id") % skip == 0).select("frame_id", "depth_width", F.posexplode(decode("depth_kind", "depth")).alias("at", "raw"))
    return f.select("frame_id", F.floor(F.col("at") / F.col("depth_width")).cast("int").alias("y"), (F.col("at") % F.col("depth_width")).alias("x"), (F.col("raw") / scale).alias("d"))


def pose_lines(frames: DataFrame, col: str = "pose") -> DataFrame:
    """frame_id and the 4x4 matrix as text, four numbers of six digits a line."""
    line = lambda k: F.format_string("%f %f %f %f", *(F.col(col)[4 * k + i] for i in range(4)))
    return frames.select("frame_id", F.concat_ws("\n", *map(line, range(4))).alias("text"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """frame_id (the number in the file's name) and the matrix of each text file."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    return t.select(F.regexp_extract("f", r"(\d+)", 1).cast("long").alias("frame_id"), F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.cast("double")).alias("m")).orderBy("frame_id")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """point_id, seg_id of segment JSON files."""
    return spark.read.schema("segIndices array<long>").option("multiLine", True).json(path).select(F.posexplode("segIndices").alias("point_id", "seg_id"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """place, group_id, label, seg_id of aggregation JSON files."""
    j = spark.read.schema("segGroups array<struct<id:long,label:string,segments:array<long>>>").option("multiLine", True).json(path)
    return j.select(F.posexplode("segGroups").alias("place", "g")).select("place", F.col("g.id").alias("group_id"), F.col("g.label").alias("label"), F.explode("g.segments").alias("seg_id"))


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """key and numbers of `key = value ...` lines."""
    kv = F.split("value", " = ", 2)
    return spark.read.text(path).where(F.col("value").contains(" = ")).select(kv[0].alias("key"), F.transform(F.split(F.trim(kv[1]), r"\s+"), lambda x: x.try_cast("double")).alias("values"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("scene_id"))


def run_length_pixels(masks: DataFrame, width: int) -> DataFrame:
    """mask_id, y, x from run lengths (`runs`: absent, present, absent, ...) along rows."""
    to = F.sum("n").over(Window.partitionBy("mask_id").orderBy("k")).cast("int")
    on = masks.select("mask_id", F.posexplode("runs").alias("k", "n")).withColumn("end", to).where("k % 2 = 1").withColumn("begin", (F.col("end") - F.col("n")).cast("int")).where("begin < end")
    return on.select("mask_id", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("at")).select("mask_id", F.floor(F.col("at") / width).cast("int").alias("y"), (F.col("at") % width).alias("x"))


def write_scenes(points: DataFrame, path: str) -> None:
    """Processed scenes, a folder for each split and scene."""
    points.write.mode("overwrite").partitionBy("split", "scene_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def list_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, number) of all files whose name ends in a number; contents are not read. Sort by number to show them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    n = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1)
    return f.where(n != "").select("path", n.cast("int").alias("number"))


def png_gray16(raw: bytes) -> np.ndarray:
    """Rows of a 16-bit grey PNG without interlacing; anything else raises."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if head is None or (head[2], head[3], head[6]) != (16, 0, 0):
        raise ValueError("not a plain 16-bit grey PNG")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + 2 * width)
    out = np.zeros((height + 1, 2 * width), np.uint8)  # the row above the first is 0
    for y, (kind, line) in enumerate(zip(lines[:, 0].tolist(), lines[:, 1:]), 1):
        up, row = out[y - 1], out[y]
        if kind == 0:
            row[:] = line
        elif kind == 1:
            row[:] = np.cumsum(line.reshape(-1, 2), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row[:] = line + up
        else:  # a pixel needs the one before it
            above, now = up.tolist(), line.tolist()
            for x in range(2 * width):
                a, b, c = (now[x - 2], above[x], above[x - 2]) if x > 1 else (0, above[x], 0)
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))
                now[x] = (now[x] + guess) & 255
            row[:] = now
    return out[1:].reshape(height, width, 2).view(">u2")[..., 0].astype(np.int32)


def read_depth_images(spark: SparkSession, path: str, scale: float = 1000.0) -> DataFrame:
    """path, width, height, depth (array by rows, in metres) of all depth PNGs under a path. Files that aren't 16-bit grey
    PNGs raise."""

    def decode(parts):
        for pdf in parts:
            for p, raw in zip(pdf.path, pdf.content):
                d = png_gray16(raw)
                yield pd.DataFrame({"path": [p], "width": [d.shape[1]], "height": [d.shape[0]], "depth": [(d.reshape(-1) / scale).tolist()]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, width int, height int, depth array<double>")


def resize_depth(images: DataFrame, width: int, height: int) -> DataFrame:
    """Depth images brought to another size by bilinear interpolation between pixel centres; the edge is repeated."""

    def axis(i, src, dst):
        at = F.greatest(F.lit(0.0), F.least((i + 0.5) * F.col(src) / dst - 0.5, F.col(src) - 1.0))
        low = F.floor(at).cast("int")
        return low, F.least(low + 1, F.col(src) - 1), at - low

    def pixel(i):
        (x0, x1, fx), (y0, y1, fy) = axis(i % width, "width", width), axis(F.floor(i / width), "height", height)
        d = lambda y, x: F.col("depth")[(y * F.col("width") + x).cast("int")]
        return (d(y0, x0) * (1 - fx) + d(y0, x1) * fx) * (1 - fy) + (d(y1, x0) * (1 - fx) + d(y1, x1) * fx) * fy

    sized = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)
    out = images.withColumn("depth", F.when((F.col("width") == width) & (F.col("height") == height), F.col("depth")).otherwise(sized))
    return out.withColumns({"width": F.lit(width), "height": F.lit(height)})


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, data (row-major, blue green red) of all images under a path, decoded by Spark."""
    i = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path)
    return i.select(F.col("image.origin").alias("path"), *(F.col(f"image.{c}").alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))))


def write_masks(masks: DataFrame, path: str) -> None:
    """Masks of frames (split, scene_id, frame_id, mask_id, runs), a folder for each split and scene; those written replace
    what was there, other scenes stay."""
    masks.write.mode("overwrite").partitionBy("split", "scene_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_masks(spark: SparkSession, path: str, split: str, scene_id: str, frame_id: int | None = None) -> DataFrame:
    """The masks of a scene, or of one of its frames; only that scene's folder is read."""
    m = spark.read.parquet(path).where((F.col("split") == split) & (F.col("scene_id") == scene_id))
    return m if frame_id is None else m.where(F.col("frame_id") == frame_id)


def list_scenes(spark: SparkSession, path: str) -> DataFrame:
    """scene_id and folder of every folder right under a path that holds a file, by path; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    root = path.rstrip("/").split("://")[-1].split(":", 1)[-1].lstrip("/")
    at = F.locate(root, F.col("path")) + len(root)
    rest = F.expr("substring(path, at + 1)")
    d = f.withColumn("at", at).where("at > 0").withColumn("scene_id", F.split(rest, "/")[0]).where(F.contains(rest, F.lit("/")))
    return d.select("scene_id", F.concat(F.expr("substring(path, 1, at)"), "scene_id").alias("folder")).distinct().orderBy("folder")


def write_ply(points: DataFrame, path: str, label: bool = False) -> None:
    """One ASCII PLY of the points of each scene (scene_id, point_id, x, y, z, red, green, blue and, `label`, label), as the
    text of a row in a folder for each scene; a scene is one group, sorted by point_id."""
    cols = ["x", "y", "z", "red", "green", "blue", *(["label"] if label else [])]

    def text(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("point_id")[cols].to_numpy(float)
        return pd.DataFrame({"scene_id": [pdf.scene_id.iloc[0]], "value": [ply_bytes(v, with_label=label).decode().rstrip("\n")]})

    d = points.select("scene_id", "point_id", *cols).groupBy("scene_id").applyInPandas(text, "scene_id string, value string")
    d.write.mode("overwrite").partitionBy("scene_id").text(path)
