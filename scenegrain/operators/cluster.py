"""Iterative numeric operators, one group (scene, segment) in one task: numpy within applyInPandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrain.operators import graph, segments


def fps_order(x: np.ndarray, k: int, centre: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(indices, distances) of farthest-point sampling from the first point, or with the centroid picked beforehand."""
    if centre:
        d = ((x - x.mean(0)) ** 2).sum(1)
        picks = [int(d.argmax())]
    else:
        d, picks = np.full(len(x), np.inf), [0]
    at = [float(np.sqrt(d[picks[0]])) if centre else np.inf]
    while len(picks) < min(k, len(x)):
        d = np.minimum(d, ((x - x[picks[-1]]) ** 2).sum(1))
        picks.append(int(d.argmax()))
        at.append(float(np.sqrt(d[picks[-1]])))
    return np.array(picks), np.array(at)


def farthest_points(points: DataFrame, group: str, k: int, centre: bool = False, max_points: int = 5_000_000) -> DataFrame:
    """group, rank, point_id, dist: up to k points of each group, all if it has no more. More than `max_points` points in
    a group (a scene) raise."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        bounded(len(pdf), max_points, "points")
        pdf = pdf.sort_values("point_id")
        i, d = fps_order(pdf[["x", "y", "z"]].to_numpy(float), k, centre)
        return pd.DataFrame({group: pdf[group].iloc[0], "rank": range(len(i)), "point_id": pdf.point_id.to_numpy()[i], "dist": np.where(np.isinf(d), 0.0, d)})

    return points.select(group, "point_id", "x", "y", "z").groupBy(group).applyInPandas(pick, f"{group} long, rank int, point_id long, dist double")


def sinkhorn(log_alpha: np.ndarray, p: np.ndarray | None = None, q: np.ndarray | None = None, eps: float = 1e-2, thresh: float = 1e-2, n_iters: int = 10) -> np.ndarray:
    """Soft transport plan for scores log_alpha and marginals p, q (equal ones if not given) in log space; stops when the
    potentials of rows and columns change by less than `thresh` in all."""
    n, m = log_alpha.shape
    p, q = np.full(n, 1 / n) if p is None else p, np.full(m, 1 / m) if q is None else q
    u, v = np.zeros(n), np.zeros(m)
    lse = lambda a, ax: np.log(np.exp(a - a.max(ax, keepdims=True)).sum(ax)) + a.max(ax)
    for _ in range(n_iters):
        before = u, v
        u = u + eps * (np.log(p + 1e-8) - lse((log_alpha + u[:, None] + v[None, :]) / eps, 1))
        v = v + eps * (np.log(q + 1e-8) - lse((log_alpha + u[:, None] + v[None, :]) / eps, 0))
        if np.abs(u - before[0]).sum() + np.abs(v - before[1]).sum() < thresh:
            break
    return np.exp((log_alpha + u[:, None] + v[None, :]) / eps)


def sinkhorn_hard(log_alpha: np.ndarray, n_iters: int = 5, slack: bool = True) -> np.ndarray:
    """Rows and columns normalised in turn in log space, with a slack row and column; the best column of each row."""
    a = np.pad(log_alpha, ((0, 1), (0, 1))) if slack else log_alpha.copy()
    lse = lambda x, ax: np.log(np.exp(x - x.max(ax, keepdims=True)).sum(ax, keepdims=True)) + x.max(ax, keepdims=True)
    for _ in range(n_iters):
        if slack:
            a[:-1] -= lse(a[:-1], 1)
            a[:, :-1] -= lse(a[:, :-1], 0)
        else:
            a -= lse(a, 1)
            a -= lse(a, 0)
    return (a[:-1, :-1] if slack else a).argmax(1)


def weighted_kmeans(x: np.ndarray, n: int, iters: int = 10, in_iters: int = 5, tau: float = 0.01, cosine: bool = False) -> np.ndarray:
    """Centres by farthest points from the centroid, then balanced assignment and means in turn.

    Scores are distances, shifted by their mean, over tau; or cosines, with rows and centres of unit length.
    """
    rows = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    mu = x[fps_order(x, n, centre=True)[0]]
    label = np.zeros(len(x), int)
    for _ in range(iters):
        if cosine:
            x, mu = rows(x), rows(mu)
            score = x @ mu.T
        else:
            d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (mu**2).sum(1) - 2 * x @ mu.T, 0))
            score = (d.mean() - d) / tau
        label = sinkhorn_hard(score, in_iters)
        hot = np.eye(len(mu))[label]
        mu = (hot.T @ x) / (hot.sum(0) + 1e-5)[:, None]
    return label


def bounded(n: int, most: int, what: str) -> None:
    """Refuses groups that don't fit one task, by a stated bound, before anything is allocated for them."""
    if n > most:
        raise ValueError(f"a group has {n} {what}; this operator takes {most}")


def spectral_embedding(adj: np.ndarray, k: int, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Smallest eigenvalues of the normalised Laplacian and their vectors, rows of unit length."""
    s = 1 / np.sqrt(np.maximum(adj.sum(1), eps))
    value, vector = np.linalg.eigh(np.eye(len(adj)) - s[:, None] * adj * s[None, :])
    return value, unit_rows(vector[:, :k])


def unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def spectral_clusters(edges: DataFrame, group: str, n_clusters: int, auto: bool = False, max_nodes: int = 5000) -> DataFrame:
    """group, id, cluster of each group's graph (group, src, dst, w). A group is one dense matrix in one task; more than
    `max_nodes` nodes raise (components are for those). auto: as many clusters as stand before the largest gap among
    the first n_clusters eigenvalues."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf[["src", "dst"]].to_numpy())
        bounded(len(ids), max_nodes, "nodes")
        a = np.zeros((len(ids),) * 2)
        i, j = np.searchsorted(ids, pdf.src), np.searchsorted(ids, pdf.dst)
        a[i, j] = pdf.w
        a = np.maximum(a, a.T)
        value, v = spectral_embedding(a, min(n_clusters, len(ids)))
        k = int(np.argmax(np.diff(value[:n_clusters]))) + 1 if auto and min(n_clusters, len(ids)) > 1 else min(n_clusters, len(ids))
        return pd.DataFrame({group: pdf[group].iloc[0], "id": ids, "cluster": weighted_kmeans(unit_rows(v[:, :k]), k, iters=20, in_iters=32)})

    return edges.select(group, "src", "dst", "w").groupBy(group).applyInPandas(run, f"{group} long, id long, cluster long")


def eigengaps(edges: DataFrame, group: str, max_nodes: int = 5000) -> DataFrame:
    """group, rank, value, gap: eigenvalues of each group's normalised Laplacian and the step to the next. More than
    `max_nodes` nodes in a group raise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf[["src", "dst"]].to_numpy())
        bounded(len(ids), max_nodes, "nodes")
        a = np.zeros((len(ids),) * 2)
        a[np.searchsorted(ids, pdf.src), np.searchsorted(ids, pdf.dst)] = pdf.w
        value, _ = spectral_embedding(np.maximum(a, a.T), 1)
        return pd.DataFrame({group: pdf[group].iloc[0], "rank": range(len(value)), "value": value, "gap": np.append(np.diff(value), 0.0)})

    return edges.select(group, "src", "dst", "w").groupBy(group).applyInPandas(run, f"{group} long, rank int, value double, gap double")


def kmeans_groups(points: DataFrame, group: str, n: int, max_cells: int = 50_000_000) -> DataFrame:
    """group, id, cluster by weighted_kmeans() over x, y, z in each group. More than `max_cells` distances raise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bounded(len(pdf) * n, max_cells, "distances")
        pdf = pdf.sort_values("point_id")
        return pd.DataFrame({group: pdf[group], "id": pdf.point_id, "cluster": weighted_kmeans(pdf[["x", "y", "z"]].to_numpy(float), min(n, len(pdf)))})

    return points.select(group, "point_id", "x", "y", "z").groupBy(group).applyInPandas(run, f"{group} long, id long, cluster long")


def spectral_point_labels(points: DataFrame, edges: DataFrame, group: str, n_clusters: int, seg: str = "spt_id", auto: bool = False) -> tuple[DataFrame, DataFrame]:
    """(point labels: point_id, cluster; segment labels: group, id, cluster): the segments' graph is clustered in each
    group and every point takes its segment's cluster. Segments without an edge have no cluster (null). Where points have
    the column `group`, segment ids may repeat in other groups."""
    labels = spectral_clusters(edges, group, n_clusters, auto)
    of = labels.select(F.col("id").alias("seg"), F.col(group).alias("of_group"), "cluster")
    on = F.col(seg) == F.col("seg")
    on = on & (F.col(group) == F.col("of_group")) if group in points.columns else on
    return points.join(of, on, "left").select("point_id", "cluster"), labels


def cluster_and_merge(points: DataFrame, edges: DataFrame, conf: DataFrame, group: str, n_clusters: int, t: float = 0.5, seg: str = "spt_id", auto: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(point_id, cluster; point_id, merged; merged, conf): segments are clustered, clusters whose mean edge weight is
    above `t` are merged, and the confidences (id, conf) of a merged cluster's segments averaged.

    Clusters are named by group and number, group * n_clusters + cluster; a merged one by the smallest of its names.
    """
    of_points, labels = spectral_point_labels(points, edges, group, n_clusters, seg, auto)
    named = labels.select("id", (F.col(group) * n_clusters + F.col("cluster")).alias("cluster"))
    between = segments.cluster_edges(edges, named).where("ci <> cj").select(F.col("ci").alias("src"), F.col("cj").alias("dst"), "w")
    merged = graph.merge_by_threshold(named.select(F.col("cluster").alias("id")).distinct(), between, t)
    of_segments = named.join(merged.select(F.col("id").alias("was"), F.col("cluster").alias("merged")), named.cluster == F.col("was")).select("id", "merged")
    point_merged = points.join(of_segments, F.col(seg) == F.col("id"), "left").select("point_id", "merged")
    scores = segments.cluster_confidence(of_segments.withColumnRenamed("merged", "cluster"), conf).withColumnRenamed("cluster", "merged")
    return of_points, point_merged, scores


def merge_segments(points: DataFrame, edges: DataFrame, conf: DataFrame, t: float = 0.5, agglomerative: bool = False, seg: str = "spt_id") -> tuple[DataFrame, DataFrame]:
    """(point_id, cluster; cluster, conf): segments are merged by the edges above `t` without clustering them first."""
    merged = graph.merge_by_threshold(points.select(F.col(seg).alias("id")).distinct(), edges, t, agglomerative)
    of_points = points.join(merged, F.col(seg) == F.col("id"), "left").select("point_id", "cluster")
    return of_points, segments.cluster_confidence(merged, conf)
