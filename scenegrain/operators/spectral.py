"""Spectral clustering of graphs of any size: vectors and edges are tables, the driver sees squares of the number of vectors.

The largest eigenvalues of the normalised adjacency are the smallest of the normalised Laplacian. A block of vectors, one
row a node, is filtered by a Chebyshev polynomial of the adjacency (each degree one join with the edges and one sum by
node), then turned to the best vectors within its span by eigenvectors of a small matrix on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.operators import clouds, graph, segments
from scenegrain.sources.tables import save


def normalised(edges: DataFrame, eps: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """(id of every node; src, dst, s in both directions) of a graph (src, dst, w): s is w over the roots of both ends' sums
    of weights (at least eps). Of repeated edges the largest weight counts; loops, null ends and null, NaN or weights of 0
    or less do nothing."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("w").cast("double").alias("w"))
    e = e.where("src IS NOT NULL AND dst IS NOT NULL AND a <> b AND w > 0 AND NOT isnan(w) AND w < double('inf')")
    e = e.groupBy("a", "b").agg(F.max("w").alias("w"))
    both = save(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(e.select("b", "a", "w")), "edges")
    root = both.groupBy(F.col("src").alias("id")).agg((1 / F.sqrt(F.greatest(F.sum("w"), F.lit(eps)))).alias("r"))
    root = save(root, "degrees")
    at = lambda end: root.select(F.col("id").alias(end), F.col("r").alias(f"r_{end}"))
    s = both.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", (F.col("w") * F.col("r_src") * F.col("r_dst")).alias("s"))
    return root.select("id"), save(s, "edges")


def columns(n: int, prefix: str = "x") -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def times(s: DataFrame, v: DataFrame, n: int, own: Column | None = None, other: Column | None = None, scale: float = 1.0) -> DataFrame:
    """id, x0..: scale * (S x) + own * x + other * y for the vectors x (and y) of `v`; y0..: the present x."""
    x, y = columns(n), columns(n, "y")
    moved = s.join(v, s.dst == v.id).select(F.col("src").alias("id"), *((F.col("s") * scale * F.col(c)).alias(c) for c in x), *(F.lit(0.0).alias(c) for c in y))
    own, other = (F.lit(0.0) if c is None else c for c in (own, other))
    kept = v.select("id", *((own * F.col(a) + other * F.col(b)).alias(a) for a, b in zip(x, y)), *(F.col(a).alias(b) for a, b in zip(x, y)))
    return save(moved.union(kept).groupBy("id").agg(*(F.sum(c).alias(c) for c in x + y)), "vectors")


def products(v: DataFrame, n: int) -> np.ndarray:
    """The matrix of products of all vectors x and y with each other, (2 n, 2 n)."""
    rows = v.select(*columns(n), *columns(n, "y"))
    return clouds.task_sums(rows, lambda a: a.T @ a, (2 * n, 2 * n))


def turned(v: DataFrame, n: int, m: np.ndarray) -> DataFrame:
    """x and y times the matrix m."""
    x, y = columns(n), columns(n, "y")

    def turn(parts):
        for pdf in parts:
            both = np.concatenate((pdf[x].to_numpy(float) @ m, pdf[y].to_numpy(float) @ m), 1)
            yield pd.concat((pdf[["id"]].reset_index(drop=True), pd.DataFrame(both, columns=x + y)), axis=1)

    return save(v.mapInPandas(turn, v.select("id", *x, *y).schema), "vectors")


def best_within(g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, falling; the turn to their vectors, n by n; their residuals) of the best vectors within a block, by the matrix
    of products of its images x = S y and vectors y. A block that spans less than its width has fewer values; the rest of
    the turn stays empty."""
    xx, xy, yy = g[:n, :n], g[:n, n:], g[n:, n:]
    e, q = np.linalg.eigh(yy)
    keep = e > e[-1] * 1e-13
    base = q[:, keep] / np.sqrt(e[keep])
    theta, c = np.linalg.eigh(base.T @ ((xy + xy.T) / 2) @ base)
    theta, c = theta[::-1], base @ c[:, ::-1]
    left = np.einsum("ij,ij->j", c, xx @ c) - 2 * theta * np.einsum("ij,ij->j", c, xy @ c) + theta**2 * np.einsum("ij,ij->j", c, yy @ c)
    return theta, np.pad(c, ((0, 0), (0, n - len(theta)))), np.sqrt(np.maximum(left, 0))


def eigenvectors(edges: DataFrame, k: int, extra: int = 8, degree: int = 8, tol: float = 1e-5, rounds: int = 40, eps: float = 1e-5) -> tuple[np.ndarray, DataFrame]:
    """(the k smallest eigenvalues of the normalised Laplacian, a table id, x0.. of their vectors) of a graph (src, dst, w).

    A block of k + `extra` vectors (fewer, if there are fewer nodes) is filtered by polynomials of `degree` until the k
    wanted leave a residual of at most `tol`, which is an error of its square over the gap in an eigenvalue, or `rounds`
    are over, which raises. Starts are made of hashes of the ids, so reruns agree. Nodes without an edge are not in the graph;
    a graph without edges has no values. A graph of several parts has a value of 0 for each.
    """
    ids, s = normalised(edges, eps)
    count = ids.count()
    n = min(k + extra, count)
    k = min(k, count)
    if not count:
        return np.zeros(0), ids.limit(0)
    start = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / float(1 << 19) - 1).alias(c) for i, c in enumerate(columns(n))]
    v = ids.select("id", *start, *(F.lit(0.0).alias(c) for c in columns(n, "y")))
    v = times(s, save(v, "vectors"), n)  # x is S times y
    for _ in range(rounds):
        g = products(v, n)
        theta, c, residual = best_within(g, n)
        v = turned(v, n, c)
        if len(theta) >= k and residual[:k].max() <= tol or count <= n and residual.max() <= tol:
            got = v.select("id", *(F.col(f"y{i}").alias(f"x{i}") for i in range(min(k, len(theta)))))
            return 1 - theta[:k], got
        # Values from -1 up to the smallest of the block are damped, larger ones grow.
        low, high = -1.0, float(min(theta[-1], 1 - 1e-9))
        high = max(high, low + 1e-3)
        middle, half = (high + low) / 2, (high - low) / 2
        # v has S y as x and y as y: the first degree is (x - middle * y) / half, from there on 2 / half * (S - middle) x - y.
        first = [((F.col(a) - F.col(b) * middle) / half).alias(a) for a, b in zip(columns(n), columns(n, "y"))]
        v = save(v.select("id", *first, *columns(n, "y")), "vectors")
        for _ in range(degree - 1):
            v = times(s, v, n, F.lit(-2 * middle / half), F.lit(-1.0), 2 / half)
        v = times(s, v, n)
    raise RuntimeError(f"eigenvectors did not settle in {rounds} rounds on {edges.sparkSession.sparkContext.appName}")


def spectral_clusters(edges: DataFrame, n_clusters: int, k: int | None = None, dst: str = "eu", tau: float = 0.01, iters: int = 20, in_iters: int = 32, auto: bool = False, **settings) -> DataFrame:
    """id, cluster: one graph (src, dst, w) of any size in n_clusters clusters, by balanced k-means over the k first
    eigenvectors' rows, made unit vectors.

    dst: "eu" compares distances over tau, "feats" cosines. auto: as many clusters and vectors as eigenvalues stand before
    the largest gap among the first k. Nodes without an edge have no row.
    """
    if dst not in ("eu", "feats"):
        raise ValueError(f"dst is {dst!r}, not 'eu' or 'feats'")
    value, v = eigenvectors(edges, k or n_clusters, **settings)
    m = len(value)
    if auto and m > 1:
        m = n_clusters = int(np.argmax(np.diff(value))) + 1
    x = columns(m)
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in x), F.lit(0.0)))
    rows = save(v.select("id", *((F.col(c) / F.greatest(length, F.lit(1e-12))).alias(c) for c in x)), "rows")
    if not m:
        return rows.select("id", F.lit(None).cast("long").alias("cluster"))
    return clouds.balanced_kmeans(rows, n_clusters, iters, in_iters, tau, dst == "feats", "id", tuple(x))


def cluster_and_merge(points: DataFrame, edges: DataFrame, conf: DataFrame, n_clusters: int = 128, k: int = 128, tau: float = 0.1, thres: float = 0.1, dst: str = "eu", seg: str = "spt_id", iters: int = 20, in_iters: int = 32, auto: bool = False, **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(point_id, cluster; point_id, merged; merged, conf) of one scene: its segments' graph (src, dst, w) is clustered,
    clusters whose mean edge weight is above `thres` are merged, named by the smallest of them, and the confidences (id, conf)
    of a merged cluster's segments averaged. Points of segments without an edge have a null cluster."""
    labels = save(spectral_clusters(edges, n_clusters, k, dst, tau, iters, in_iters, auto, **settings), "labels")
    between = segments.cluster_edges(edges, labels).where("ci <> cj").select(F.col("ci").alias("src"), F.col("cj").alias("dst"), "w")
    merged = graph.merge_by_threshold(labels.select(F.col("cluster").alias("id")).distinct(), between, thres)
    of = labels.join(merged.select(F.col("id").alias("was"), F.col("cluster").alias("merged")), labels.cluster == F.col("was")).select("id", "cluster", "merged")
    named = save(of, "merged")
    out = points.select("point_id", F.col(seg).alias("of_")).join(named, F.col("of_") == F.col("id"), "left")
    scores = segments.cluster_confidence(named.select("id", F.col("merged").alias("cluster")), conf).withColumnRenamed("cluster", "merged")
    return out.select("point_id", "cluster"), out.select("point_id", "merged"), scores
