"""Column functions: camera and vector arithmetic, hashing keys, label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: The default camera and the words that no label may be.
FX = FY = 577.870605
CX, CY = 319.5, 239.5
WIDTH, HEIGHT = 640, 480
STOP_WORDS = ["background", "box", "contours"]
NO_LABEL = "floor"


def intrinsic(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Row-major 4x4 camera matrix."""
    z, o = F.lit(0.0), F.lit(1.0)
    return F.array(fx, z, cx, z, z, fy, cy, z, z, z, o, z, z, z, z, o)


def adjust_intrinsic(fx, fy, cx, cy, src: tuple[int, int], dst: tuple[int, int]) -> list[Column]:
    """fx, fy, cx, cy for another image size: focal lengths by the resized sides, centres by the sides less 1."""
    if src == dst:
        return [fx, fy, cx, cy]
    width = F.floor(F.lit(dst[1]) * src[0] / F.lit(float(src[1]))).cast("double")
    return [fx * width / src[0], fy * F.lit(float(dst[1])) / src[1], cx * F.lit(float(dst[0] - 1)) / (src[0] - 1), cy * F.lit(float(dst[1] - 1)) / (src[1] - 1)]


def scale_mapping(x: Column, y: Column, a: float, b: float, c: float, d: float) -> tuple[Column, Column]:
    return x * F.lit(c / a), y * F.lit(d / b)


def pixel(v: Column, focal: Column, depth: Column, centre: Column) -> Column:
    """Pinhole projection, rounded half to even; a depth near 0 counts as EPS, whatever its sign."""
    z = F.when(F.abs(depth) < EPS, F.lit(EPS)).otherwise(depth)
    return F.bround(v * focal / z + centre, 0).cast("long")


def normalize_color(c: Column) -> Column:
    return c / 127.5 - 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def remap_similarity(cos: Column, least: float) -> Column:
    """(cos + 1) / 2 within [0, 1]; below `least` it is 1 (no penalty)."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))
    return F.when(s < least, F.lit(1.0)).otherwise(s)


def morton(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """Bits of x, y and z interleaved, x lowest (up to 21 bits each)."""
    code = F.lit(0).cast("long")
    for i in range(bits):
        for k, v in enumerate((x, y, z)):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(v.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), 3 * i + k))
    return code


def fnv_key(parts: list[Column]) -> Column:
    """FNV-1 over whole coordinates modulo 2^64 as DECIMAL(20,0): multiply, then exclusive or.

    There are no unsigned integers and overflow raises, so the state is four 16-bit limbs in BIGINT columns.
    """
    prime = [0x01B3, 0x0000, 0x0100, 0x0000]
    basis = 14695981039346656037
    h = [F.lit((basis >> (16 * i)) & 0xFFFF).cast("long") for i in range(4)]
    for p in parts:
        out, carry = [], F.lit(0).cast("long")
        for i in range(4):
            s = carry
            for j in range(i + 1):
                if prime[i - j]:
                    s = s + h[j] * F.lit(prime[i - j]).cast("long")
            out.append(s.bitwiseAND(F.lit(0xFFFF).cast("long")))
            carry = F.shiftright(s, 16)
        h = [o.bitwiseXOR(F.shiftright(p.cast("long"), 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))) for i, o in enumerate(out)]
    d = "decimal(38,0)"
    total = sum((h[i].cast(d) * F.lit(str(1 << (16 * i))).cast(d) for i in (1, 2, 3)), h[0].cast(d))
    return total.cast("decimal(20,0)")


def rotation(axis: tuple[float, float, float], theta: float) -> list[list[float]]:
    """Rotation matrix about an axis, in closed form."""
    import math

    n = math.sqrt(sum(a * a for a in axis))
    x, y, z = (a / n for a in axis)
    c, s, k = math.cos(theta), math.sin(theta), 1 - math.cos(theta)
    return [[c + x * x * k, x * y * k - z * s, x * z * k + y * s], [y * x * k + z * s, c + y * y * k, y * z * k - x * s], [z * x * k - y * s, z * y * k + x * s, c + z * z * k]]


def clean_list(items: Column) -> Column:
    """Drops null, blank, all-digit and one-character items; an empty result is [floor]."""
    kept = F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "") & ~x.rlike("^[0-9]+$") & (F.length(x) > 1))
    return F.when(F.size(kept) == 0, F.array(F.lit(NO_LABEL))).otherwise(kept)


def drop_stop_words(items: Column) -> Column:
    return F.filter(items, lambda x: ~x.isin(STOP_WORDS))


def strip_alnum(s: Column) -> Column:
    return F.regexp_replace(s, "[0-9a-zA-Z]", "")


def clean_label(s: Column) -> Column:
    """Letters, digits and white space only, trimmed; empty or more than two words: floor."""
    t = F.trim(F.regexp_replace(s, r"[^a-zA-Z0-9\s]+", ""))
    return F.when((t == "") | (F.size(F.split(t, r"\s+")) > 2), F.lit(NO_LABEL)).otherwise(t)


def after_marker(s: Column, marker: str = "[/INST]") -> Column:
    return F.lower(F.substring_index(s, marker, -1))


def normalize_output(s: Column) -> Column:
    t = F.lower(F.trim(s))
    return F.when(t.isNull() | (t == ""), F.lit(NO_LABEL)).otherwise(t)


def with_suffix(s: Column) -> Column:
    return F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))


def chunked(items: Column, size: int = 5) -> Column:
    """The array in runs of `size`, the last one shorter."""
    n = F.greatest(F.ceil(F.size(items) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(items, i * size + 1, size))
