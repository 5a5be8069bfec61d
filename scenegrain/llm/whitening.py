"""Whitening of embeddings by distributed block matrices.

Vectors become whole numbers on a fixed grid, so counts, sums and deviations are exact. Each different vector is fitted
once: its centred row is indexed into a BlockMatrix whose transpose times itself is the scatter matrix. Its
eigenvectors, found on the driver from one square of the number of dimensions, make a whitening matrix, by which a
second product of block matrices projects the rows. Blocks have a bounded size; the scatter is summed over splits of the
rows, so no task holds all of them.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.sources.tables import save

#: Entries of the grid stop here, so that no sum of theirs overflows before it is a decimal.
TOP = 1 << 56
#: Eigenvalues below this share of the largest, times the dimensions, are numerically none.
RANK = 1e-13
#: Doubles in a block of rows: 4 MB.
BLOCK = 1 << 19


def on_grid(vec: Column, step: int, shift: int) -> Column:
    """floor(step * c) + shift of every entry, as longs; beyond TOP either way an entry counts as TOP."""
    top = F.lit(float(TOP))
    return F.transform(vec, lambda c: F.floor(F.greatest(-top, F.least(top, c.cast("double") * step))) + shift)


def numbered_rows(vectors: DataFrame, step: int, shift: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, x, dims, row_no: usable rows, numbered 0, 1, ... by the offsets of the partitions."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    d = vectors.where(v.isNotNull() & ~bad & (F.size(v) > 0))
    d = d.select(F.col(id_col).alias("vec_id"), on_grid(v, step, shift).alias("x"))
    d = d.withColumn("dims", F.size("x")).withColumn("part", F.spark_partition_id())
    d = save(d.withColumn("at", F.monotonically_increasing_id() % (1 << 33)), "grid")
    sizes = d.groupBy("part", "dims").count()
    w = Window.partitionBy("dims").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "dims", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("start"))
    # Within a partition each length is counted apart, so every length has numbers without gaps.
    own = Window.partitionBy("part", "dims").orderBy("at")
    mixed = sizes.groupBy("part").count().where("count > 1")
    if mixed.isEmpty():
        return d.join(F.broadcast(starts), ["part", "dims"]).select("vec_id", "x", "dims", (F.col("start") + F.col("at")).alias("row_no"))
    ranked = d.withColumn("at", F.row_number().over(own) - 1)
    return ranked.join(F.broadcast(starts), ["part", "dims"]).select("vec_id", "x", "dims", (F.col("start") + F.col("at")).alias("row_no"))


def block_matrix(rows: DataFrame, n_rows: int, dims: int) -> BlockMatrix:
    """(row_no, centred) as a matrix of n_rows x dims, in blocks of at most BLOCK doubles; rows that lack are zero."""
    vectors = rows.select("row_no", array_to_vector("centred").alias("centred"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "centred"), n_rows, dims)
    return indexed.toBlockMatrix(max(64, BLOCK // dims), dims)


def scatter(a: BlockMatrix, blocks_a_split: int = 8) -> np.ndarray:
    """The transpose of `a` times `a`. PySpark's multiply() lacks the JVM method's number of splits along the rows;
    without them one task would hold all blocks."""
    splits = max(1, -(-a.numRowBlocks // blocks_a_split))
    left = a.transpose()
    product = left._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    v = BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()
    return (v + v.T) / 2


def projected(a: BlockMatrix, w: np.ndarray) -> DataFrame:
    """row_no, white: each row of `a` times `w`."""
    sc = a.blocks.context
    right = BlockMatrix(sc.parallelize([((0, 0), Matrices.dense(*w.shape, w.ravel(order="F").tolist()))], 1), *w.shape, *w.shape)
    rows = callMLlibFunc("getIndexedRows", a.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.toDF("row_no", "white").select("row_no", vector_to_array("white").alias("white"))


def covariance_of(rows: DataFrame, n: int, k: int) -> np.ndarray:
    """Covariance of `white`, whose rows are projections of centred ones, by sums a batch."""

    def sums(parts):
        total, seen = np.zeros((k + 1, k)), False
        for pdf in parts:
            if len(pdf):
                z = np.array(pdf.white.tolist(), float)
                total[:k] += z.T @ z
                total[k] += z.sum(0)
                seen = True
        if seen:
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    got = rows.select("white").mapInPandas(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    s = np.zeros((k + 1) * k)
    for r in got:
        s[r["at"]] = r.v
    s = s.reshape(k + 1, k) / n
    return s[:k] - np.outer(s[k], s[k])


def fit_and_project(base: DataFrame, dims: int, components: int) -> DataFrame:
    fit = save(base.groupBy("x").agg(F.min("row_no").alias("row_no")), "fit")
    n, n_rows = fit.count(), base.count()
    entry = F.col("e").cast("decimal(20,0)")
    sides = fit.select(F.posexplode("x").alias("at", "e")).groupBy("at").agg(F.sum(entry).alias("s"), F.min("e").alias("lo"), F.max("e").alias("hi"))
    # One row a dimension.
    by = sorted(sides.collect(), key=lambda r: r["at"])
    s = [int(r.s) for r in by]
    far = max(max(n * int(r.hi) - t, t - n * int(r.lo)) for r, t in zip(by, s))
    wide = max(abs(int(v)) for r in by for v in (r.lo, r.hi)) * n
    fits = wide < 1 << 62 and dims * far * far < 1 << 63
    if fits:
        difference = F.zip_with("x", F.lit(s), lambda a, t: a * F.lit(n) - t)
        deviation = F.aggregate("difference", F.lit(0).cast("long"), lambda t, a: t + a * a)
    else:
        wide_type, sums = "decimal(38,0)", F.array(*(F.lit(Decimal(t)).cast("decimal(38,0)") for t in s))
        difference = F.zip_with("x", sums, lambda a, t: (a.cast("decimal(19,0)") * F.lit(Decimal(n)) - t).cast(wide_type))
        square = lambda a: F.try_multiply(a, a).cast(wide_type)
        deviation = F.aggregate("difference", F.lit(Decimal(0)).cast(wide_type), lambda t, a: F.try_add(t, square(a)).cast(wide_type)).try_cast("long")
    centred = F.transform("difference", lambda a: a.cast("double") / float(n))
    ready = lambda d: d.withColumn("difference", difference).withColumn("centred", centred)

    v = scatter(block_matrix(ready(fit), n_rows, dims)) / n
    value, vector = np.linalg.eigh(v)
    k = min(components, dims)
    value, vector = np.maximum(value[::-1][:k], 0), vector[:, ::-1][:, :k]
    trace = float(np.trace(v))
    good = value > RANK * dims * value[0] if trace > 0 else np.zeros(k, bool)
    m = int(good.sum())
    explained = [float(e) / trace if g else 0.0 for e, g in zip(value, good)]
    out = base.select("vec_id", "x", "row_no")
    if m:
        white = save(projected(block_matrix(ready(base), n_rows, dims), vector[:, :m] / np.sqrt(value[:m])), "white")
        error = float(np.abs(covariance_of(white.join(fit.select("row_no"), "row_no", "left_semi"), n, m) - np.eye(m)).max())
        out = out.join(white, "row_no")
    else:
        error, out = 0.0, out.withColumn("white", F.array().cast("array<double>"))
    out = out.withColumn("difference", difference).withColumn("deviation", deviation)
    parts = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda c: F.struct(c.alias("component"), F.get("white", c - 1).alias("whitened")))
    out = out.select("vec_id", "deviation", F.explode(parts).alias("p"))
    share = F.element_at(F.lit(explained), F.col("p.component"))
    return out.select(
        "vec_id",
        "p.component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "p.whitened",
        share.alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whiten(vectors: DataFrame, components: int = 16, step: int = 64, shift: int = 1_000_000, most_dims: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    Null and empty vectors and those with null or non-finite entries are dropped. Vectors of different lengths are spaces of
    their own, each fitted apart; beyond `most_dims` dimensions, whose covariance the driver would hold, it raises. Repeated
    rows and null ids stay; equal vectors are fitted once. Components beyond the rank of the fitted vectors (all of them,
    if there is one vector) explain 0 and have a null `whitened`; the identity error is that of the others. A deviation
    beyond a long is null. Equal eigenvalues may come with any basis of their space. An empty table gives an empty one.
    """
    base = save(numbered_rows(vectors, step, shift, id_col, vec_col), "rows")
    lengths = sorted(r.dims for r in base.select("dims").distinct().collect())
    if lengths and lengths[-1] > most_dims:
        raise ValueError(f"vectors have {lengths[-1]} dimensions; the driver solves at most {most_dims}")
    kind = base.schema["vec_id"].dataType.simpleString()
    names = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = base.sparkSession.createDataFrame([], names)
    parts = [fit_and_project(base.where(F.col("dims") == dims) if len(lengths) > 1 else base, dims, components) for dims in lengths]
    for part in parts:
        out = part if len(parts) == 1 else out.union(part)
    return out
