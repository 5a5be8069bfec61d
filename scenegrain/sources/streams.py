"""Sensor streams read by offset, and a sink of named files: data sources for paths that all executors mount."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.functions import pandas_udf

from scenegrain.sources.formats import COLOR_CODES, DEPTH_CODES, STREAM, STREAM_VERSION


def mounted(path: str) -> str:
    """The path of a file: URL, or a plain path; other stores raise, as files are opened and sought in."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} isn't a mounted path")
    return path


def taken(f, form: str) -> tuple:
    """The next values of a little-endian form; a file that ends before raises."""
    raw = f.read(struct.calcsize("<" + form))
    if len(raw) < struct.calcsize("<" + form):
        raise EOFError(f"{f.name} ends within a header or frame")
    return struct.unpack("<" + form, raw)


def stream_header(f) -> dict:
    version, size = taken(f, "IQ")
    if version != STREAM_VERSION:
        raise ValueError(f"stream version {version}")
    sensor = taken(f, f"{size}s")[0].decode()
    matrices = [list(taken(f, "16f")) for _ in range(4)]
    color, depth, _, _, width, height, shift, n = taken(f, "iiIIIIfQ")
    return {"sensor": sensor, "matrices": matrices, "kinds": (COLOR_CODES[color], DEPTH_CODES[depth]), "depth": (width, height, shift), "n": n}


@dataclass
class Frames(InputPartition):
    """`n` frames of a file from frame `first`, which starts at byte `offset`."""

    path: str
    first: int
    n: int
    offset: int


class StreamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = mounted(options["path"]), int(options.get("partition_bytes", 128 << 20))

    def partitions(self) -> list[Frames]:
        files = [self.path]
        if os.path.isdir(self.path):
            files = sorted(os.path.join(at, f) for at, _, names in os.walk(self.path) for f in names if f.endswith(".sens"))
        return [p for f in files for p in self.ranges(f)] or [Frames("", 0, 0, 0)]

    def ranges(self, path: str) -> Iterator[Frames]:
        """Runs of whole frames of about `most` bytes: only the 96 bytes before the payloads of a frame are read."""
        with open(path, "rb") as f:
            n = stream_header(f)["n"]
            first, start = 0, f.tell()
            for i in range(n):
                f.seek(80, os.SEEK_CUR)  # the pose and two times
                f.seek(sum(taken(f, "QQ")), os.SEEK_CUR)
                if f.tell() - start >= self.most or i == n - 1:
                    yield Frames(path, first, i + 1 - first, start)
                    first, start = i + 1, f.tell()

    def read(self, part: Frames) -> Iterator[tuple]:
        if not part.n:
            return
        with open(part.path, "rb") as f:
            h = stream_header(f)
            f.seek(part.offset)
            for i in range(part.first, part.first + part.n):
                pose = list(taken(f, "16f"))
                color_at, depth_at, n_color, n_depth = taken(f, "QQQQ")
                color, depth = taken(f, f"{n_color}s{n_depth}s")
                times = Decimal(color_at), Decimal(depth_at)
                yield (f"file:{part.path}", h["sensor"], i, pose, *h["matrices"], *times, *h["kinds"], *h["depth"], color, depth)


class SensorStreams(DataSource):
    """`spark.read.format("sensor_stream").load(path)`: a row for each frame of a stream or of all .sens files in a folder.

    Partitions are runs of frames of about `partition_bytes`, which tasks seek, so a stream may be of any size and a task
    holds one frame. The driver reads the headers. Files that are cut off or of another version raise.
    """

    @classmethod
    def name(cls) -> str:
        return "sensor_stream"

    def schema(self) -> str:
        return STREAM

    def reader(self, schema) -> StreamReader:
        return StreamReader(self.options)


@dataclass
class Part(WriterCommitMessage):
    folder: str


class FileWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = mounted(options["path"]), overwrite
        self.parts = os.path.join(self.path, f"_parts-{uuid.uuid4().hex}")

    def write(self, rows) -> Part:
        folder, name, out = os.path.join(self.parts, uuid.uuid4().hex), None, None
        os.makedirs(folder)
        try:
            for row in rows:
                if row.name is None or row.name.startswith(("/", "_")) or ".." in row.name.split("/"):
                    raise ValueError(f"{row.name!r} is no name of a file below the folder")
                if row.name != name:
                    if out:
                        out.close()
                    name, at = row.name, os.path.join(folder, row.name)
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    out = open(at, "xb")  # rows of a name must follow one another
                out.write(row.content.encode() if isinstance(row.content, str) else bytes(row.content or b""))
        finally:
            if out:
                out.close()
        return Part(folder)

    def moves(self, folders: list[str]) -> Iterator[tuple[str, str]]:
        for folder in folders:
            for at, _, names in os.walk(folder):
                for n in names:
                    yield os.path.join(at, n), os.path.join(self.path, os.path.relpath(os.path.join(at, n), folder))

    def commit(self, messages) -> None:
        """Files of tasks that count move into place; a name that two tasks wrote raises before any does."""
        folders, seen = [m.folder for m in messages if m], set()
        for _, to in self.moves(folders):
            if to in seen or (not self.overwrite and os.path.exists(to)):
                raise FileExistsError(to)
            seen.add(to)
        for at, to in self.moves(folders):
            os.makedirs(os.path.dirname(to), exist_ok=True)
            os.replace(at, to)
        self.cleared()

    def abort(self, messages) -> None:
        self.cleared()

    def cleared(self) -> None:
        for at, folders, names in os.walk(self.parts, topdown=False):
            for n in names:
                os.remove(os.path.join(at, n))
            for n in folders:
                os.rmdir(os.path.join(at, n))
        if os.path.isdir(self.parts):
            os.rmdir(self.parts)


class NamedFiles(DataSource):
    """Sink of (name, content): a file for each name, its rows one after another (text as UTF-8, null as nothing).

    Rows of a name must be in one partition and follow one another; a task holds one row. Tasks write into folders of their
    own, so retries and lost executors leave nothing; the commit moves whole files. "append" refuses names that exist,
    "overwrite" replaces these files and leaves others.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for s in (SensorStreams, NamedFiles):
        spark.dataSource.register(s)


def read_stream_ranges(spark: SparkSession, path: str, partition_bytes: int = 128 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("sensor_stream").option("partition_bytes", partition_bytes).load(path)


def write_files(files: DataFrame, path: str, mode: str = "append", order: str | None = None) -> None:
    """Writes (name, content) as files; with `order`, rows of a name are brought together and sorted by that column."""
    register(files.sparkSession)
    if order:
        files = files.repartition("name").sortWithinPartitions("name", order)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").mode(mode).save(path)


def png_of_gray16(pixels: np.ndarray) -> bytes:
    """A 16-bit grey PNG without interlacing and filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = pixels.shape
    lines = np.zeros((height, 1 + 2 * width), np.uint8)
    lines[:, 1:] = np.ascontiguousarray(pixels.astype(">u2")).view(np.uint8).reshape(height, 2 * width)
    head = struct.pack(">IIBBBBB", width, height, 16, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def depth_png(width: Column, height: Column, depth: Column, scale: float = 1000.0) -> Column:
    """The PNG of depths in metres by rows, in steps of 1 / scale; null depths are 0, those beyond 16 bits raise."""

    @pandas_udf("binary")
    def encode(w: pd.Series, h: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for width, height, x in zip(w, h, d):
            p = np.rint(np.nan_to_num(np.array(x, float)) * scale)
            if len(p) and (p.min() < 0 or p.max() > 65535):
                raise ValueError("a depth doesn't fit 16 bits")
            out.append(png_of_gray16(p.reshape(height, width)))
        return pd.Series(out)

    return encode(width, height, depth)


def ply_files(points: DataFrame, *extra: str, scene: str = "scene_id", key: str = "point_id") -> DataFrame:
    """name, part, content: the rows of an ASCII PLY for each scene, to be written in order of `part`.

    A row is a line, so no scene is held whole. Columns: x, y, z, then red, green, blue if the points have them, then whole
    numbers in the `extra` columns (label, instance). Null coordinates are nan, other nulls 0. Keys aren't null.
    """
    color = [c for c in ("red", "green", "blue") if c in points.columns]
    kinds = [*((c, "float") for c in "xyz"), *((c, "uchar") for c in color), *((c, "int") for c in extra)]
    head = "\n".join(f"property {t} {c}" for c, t in kinds)
    name = F.concat(F.col(scene).cast("string"), F.lit(".ply")).alias("name")
    n = points.groupBy(scene).agg(F.count("*").alias("n"))
    first = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n").cast("string"), F.lit(f"\n{head}\nend_header\n"))
    number = {"float": lambda c: F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float"))}
    value = [number.get(t, lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)))(c).cast("string") for c, t in kinds]
    lines = points.select(name, F.struct(F.lit(1).alias("at"), F.col(key).cast("long").alias("key")).alias("part"), F.concat(F.concat_ws(" ", *value), F.lit("\n")).alias("content"))
    heads = n.select(name, F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("key")).alias("part"), first.alias("content"))
    return heads.union(lines)


def matrix_files(frames: DataFrame, frame: str = "frame_id", matrix: str = "pose") -> DataFrame:
    """name, content: a text of four lines for each 4x4 matrix, named by its frame."""
    line = lambda k: F.concat_ws(" ", *(F.col(matrix)[4 * k + i].cast("string") for i in range(4)))
    text = F.concat(F.concat_ws("\n", *map(line, range(4))), F.lit("\n"))
    return frames.select(F.concat(F.col(frame).cast("string"), F.lit(".txt")).alias("name"), text.alias("content"))
