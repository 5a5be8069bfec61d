"""Spectral clustering of points whose graph is never written out: every two points of a group at a distance d < r are
linked with weight exp(-d).

Such a graph has as many edges as the square of its nodes in a crowded scene. So a table holds the points in blocks, one
row a block, and a product of the adjacency with vectors makes the weights of two blocks anew, some hundred rows at a time,
in the task where the two meet. Memory is bounded by two blocks; time stays the square of a group over the cores.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.operators import bands, clouds, cluster, graph, segments, spectral
from scenegrain.sources.tables import save

STATE = "g long, block long, ids array<long>, c array<double>, root array<double>, x array<double>, y array<double>"
PART = "g long, block long, s array<double>"


def weights(p: np.ndarray, q: np.ndarray, r: float) -> np.ndarray:
    """exp(-d) for the distances d < r of all rows of p and q, else 0."""
    d = np.square(p[:, 0, None] - q[None, :, 0])
    for i in (1, 2):
        t = p[:, i, None] - q[None, :, i]
        d += np.square(t, out=t)
    near = d < r * r * (1 + 1e-12)
    if 2 * np.count_nonzero(near) > d.size:
        t = np.sqrt(d, out=d)
        w = np.exp(-t)
        w *= t < r
        return w
    near = np.flatnonzero(near)
    t = np.sqrt(d.ravel()[near])
    w = np.zeros(d.size, d.dtype)
    w[near] = np.where(t < r, np.exp(-t), 0)
    return w.reshape(d.shape)


def morton(side: float) -> Column:
    """A number for the cell of a point; cells of neighbouring numbers mostly lie near each other. Only an order: cells beyond
    a million sides from the origin share one."""

    def spread(c: str) -> Column:
        x = F.least(F.greatest(F.floor(F.col(c) / F.lit(side)), F.lit(-(1 << 20))), F.lit((1 << 20) - 1)).cast("long") + F.lit(1 << 20)
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    x, y, z = map(spread, "xyz")
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def in_blocks(points: DataFrame, group: str | None, r: float, key: str = "point_id", rows: int = 8192, mass: str | None = None, begin: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(state: g, block, ids, c, empty root, x: the column `mass` or 1, y: the arrays `begin` or empty; near: g, a <= b, blocks
    that may hold points within r). Blocks hold up to `rows` points that lie near each other, and so do runs of their points.
    Points with a null id, group or bad coordinate are left out, repeated ids count once."""
    p = placed(points, group, key, [c for c in (mass, begin) if c])
    d = graph.dense_ids(p, F.struct("g", morton(r / 16).alias("cell"), "id"), "at", void=None).withColumn("block", F.floor(F.col("at") / rows))
    ends = [F.array(*(f(c) for c in "xyz")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    m = F.struct("at", "id", "x", "y", "z", *([F.col(mass).cast("double").alias("mass")] if mass else []), *([F.col(begin).alias("begin")] if begin else []))
    b = save(d.groupBy("g", "block").agg(F.sort_array(F.collect_list(m)).alias("m"), *ends), "blocks")
    none = F.array().cast("array<double>")
    own = F.col("m.mass") if mass else F.transform("m", lambda t: F.lit(1.0))
    state = b.select("g", "block", F.col("m.id").alias("ids"), F.flatten(F.transform("m", lambda t: F.array(t.x, t.y, t.z))).alias("c"), none.alias("root"), own.alias("x"), (F.flatten("m.begin") if begin else none).alias("y"))
    box = lambda n: b.select("g", F.col("block").alias(n), F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}"))
    gaps = [F.greatest(F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i], F.lit(0.0)) for i in range(3)]
    near = box("a").join(box("b"), "g").where("a <= b").where(sum((t * t for t in gaps[1:]), gaps[0] * gaps[0]) <= r * r * (1 + 1e-9))
    return state, save(near.select("g", "a", "b"), "near")


def products(state: DataFrame, near: DataFrame, r: float, links: bool = False, single: bool = False, chunk: int = 64, wide: int = 1024) -> DataFrame:
    """g, block, s: parts of the sums over all links of a block's points of weight * root * x of the other end, of which the
    whole is the sum by block. With `links` also the same for weights of 1, behind the others. `single` makes weights and
    their products in single precision, by places from the middle of `chunk` points, in about half the time. Squares of `chunk` by `wide` pairs fit a cache."""
    kind = np.float32 if single else np.float64
    ends = near.select("g", F.col("a").alias("block"), "a", "b").union(near.where("a <> b").select("g", "b", "a", "b"))
    n = near.count()
    ends = F.broadcast(ends) if n <= 100_000 else ends

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        g, a, b = (int(k) for k in key)
        at = {}
        for row in pdf.itertuples():
            m = len(row.c) // 3
            at[row.block] = np.reshape(row.c, (m, 3)), np.reshape(row.x, (m, -1)) * np.reshape(row.root, (m, 1))
        if a not in at or b not in at:  # a block of points without links is gone
            return pd.DataFrame({"g": [], "block": [], "s": []})
        (p, u), (q, v) = at[a], at[b]  # for a == b the same
        sums = [[np.zeros((len(p), v.shape[1])), np.zeros((len(q), u.shape[1]))] for _ in range(1 + links)]
        u, v = u.astype(kind), v.astype(kind)
        places = np.ascontiguousarray(q.T)  # by axis
        for i in range(0, len(p), chunk):
            few = p[i : i + chunk]
            gap = sum(np.square(np.maximum(0, np.maximum(few[:, x].min() - c, c - few[:, x].max()))) for x, c in enumerate(places))
            reached = np.flatnonzero(gap <= r * r * (1 + 1e-9))  # the others are too far from all of these points
            middle = few.mean(0) if single else np.zeros(3)
            if a == b:
                reached = reached[reached >= i]  # each pair once
            for k in range(0, len(reached), wide):
                of = reached[k : k + wide]
                w = weights((few - middle).astype(kind), (places[:, of] - middle[:, None]).astype(kind).T, r)
                for s, m in zip(sums, (w, (w > 0).astype(kind)) if links else (w,)):
                    here = np.flatnonzero(of < i + len(few)) if a == b else of[:0]  # a square whose pairs are there both ways
                    m[of[here] - i, here] = 0
                    s[0][i : i + chunk] += m @ v[of]
                    s[0 if a == b else 1][of[len(here) :]] += m[:, len(here) :].T @ u[i : i + chunk]
        out = [(g, x, np.concatenate([s[j] for s in sums], 1).ravel()) for j, x in enumerate((a, b) if a != b else (a,))]
        return pd.DataFrame(out, columns=["g", "block", "s"])

    met = state.select("g", "block", "c", "root", "x").join(ends, ["g", "block"])
    return met.repartition(max(1, min(n, 2000)), "g", "a", "b").groupBy("g", "a", "b").applyInPandas(meet, PART)


def changed(state: DataFrame, parts: DataFrame, f) -> DataFrame:
    """The state with f(g, s, ids, c, root, x, y) for each block, s being the whole sum; blocks that get empty go."""

    def put(key, own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.itertuples():
            m = len(row.ids)
            s = sum(pdf.s.tolist()[1:], pdf.s.iloc[0].copy()).reshape(m, -1)
            got = f(int(key[0]), s, row.ids, np.reshape(row.c, (m, 3)), row.root, np.reshape(row.x, (m, -1)), np.reshape(row.y, (m, -1)))
            if len(got[0]):
                out.append((*(int(k) for k in key), *(np.ravel(v) for v in got)))
        return pd.DataFrame(out, columns=["g", "block", "ids", "c", "root", "x", "y"])

    both = state.groupBy("g", "block").cogroup(parts.groupBy("g", "block"))
    return save(both.applyInPandas(put, STATE), "vectors")


def hashed(ids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of -1 to 1, n for each id, the same in each run."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(m)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)) / float(1 << 52) - 1


def moments(state: DataFrame) -> dict[int, np.ndarray]:
    """The matrix of products of all vectors x and y with each other, (2 n, 2 n), of each group."""

    def task(parts):
        for pdf in parts:
            for row in pdf.itertuples():
                m = len(row.ids)
                v = np.concatenate((np.reshape(row.x, (m, -1)), np.reshape(row.y, (m, -1))), 1)
                yield pd.DataFrame([(row.g, (v.T @ v).ravel())], columns=["g", "s"])

    sums = state.mapInPandas(task, "g long, s array<double>").groupBy("g").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    return {r.g: np.reshape(r.s, (int(round(len(r.s) ** 0.5)), -1)) for r in sums.collect()}


def eigenvectors(points: DataFrame, r: float, k: int, group: str | None = None, key: str = "point_id", extra: int = 8, degree: int = 8, tol: float = 1e-5, rounds: int = 40, eps: float = 1e-5, rows: int = 8192, mass: str | None = None, begin: str | None = None, block: bool = False) -> tuple[dict[int, np.ndarray], DataFrame]:
    """({group: the k smallest eigenvalues of its normalised Laplacian}, a table g, id, x: array of the vectors' entries), as
    spectral.eigenvectors() finds them for edges, of all groups at once. Points without a link aren't in the graph. Groups
    that settle drop out; those that don't in `rounds` raise. The driver holds a matrix of (2 (k + extra)) squared a group.

    A column `mass` makes a point stand for as many of its place, and with `block` the extra vectors, which have not settled,
    are returned too. `begin` (arrays of k + extra entries; NaN: not known) holds vectors to start from. Four of hashes go
    along with them and nothing counts as settled before a round is over, so that what they leave out is found."""
    state, near = in_blocks(points, group, r, key, rows, mass, begin)
    ones = state.withColumn("root", F.transform("ids", lambda i: F.lit(1.0)))

    def rooted(g, s, ids, c, root, x, y):
        some = s[:, 0] > 0
        return ids[some], c[some], np.sqrt(x[some, 0] / np.maximum(s[some, 0], eps)), [], y[some]

    state = changed(ones, products(ones, near, r), rooted)
    count = {t.g: t.n for t in state.groupBy("g").agg(F.sum(F.size("ids")).alias("n")).collect()}
    width = {g: min(k + extra, n) + (4 if begin else 0) for g, n in count.items()}

    def first(g: int, ids: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = hashed(ids, width[g])
        if len(y):
            x /= np.sqrt(count[g])  # as long as the others
            y = np.reshape(y, (len(ids), -1))
            x[:, : y.shape[1]] = np.where(np.isnan(y), x[:, : y.shape[1]], y)
        return x.ravel()

    def begun(parts):
        for pdf in parts:
            pdf["x"] = [first(*t) for t in zip(pdf.g, pdf.ids, pdf.y)]
            pdf["y"] = [np.zeros_like(x) for x in pdf.x]
            yield pdf

    def times(state: DataFrame, by: dict[int, tuple[float, float, float]], measured: bool = True) -> DataFrame:
        """scale * (S x) + own * x + other * y for x, and x for y. What is measured afterwards is made in double precision."""

        def f(g, s, ids, c, root, x, y):
            scale, own, other = by[g]
            return ids, c, root, scale * root[:, None] * s + own * x + other * y, x

        return changed(state, products(state, near, r, single=not measured and tol >= 1e-4), f)

    plain = dict.fromkeys(count, (1.0, 0.0, 0.0))
    value, done = {}, []
    if count:
        state = times(save(state.mapInPandas(begun, STATE), "vectors"), plain, not begin)  # x is S times y
        state = times(state, plain) if begin else state  # smooths what the start has in steps
    left = set(count)
    for turned_before in range(rounds):
        if not left:
            break
        soon = begin and not turned_before
        turn, bounds, over, turns = {}, {}, set(), 4 if soon else 1
        for g, m in moments(state).items():
            n = width[g]
            theta, c, residual = spectral.best_within(m, n)
            wanted = min(k, count[g])
            if not soon and (len(theta) >= wanted and residual[:wanted].max() <= tol or count[g] <= n and residual.max() <= tol):
                value[g] = 1 - theta[:wanted]
                over.add(g)
            high = max(float(min(theta[-1], 1 - 1e-9)), -1 + 1e-3)  # values from -1 up to the block's smallest are damped
            turn[g], bounds[g] = c, ((high - 1.0) / 2, (high + 1.0) / 2)
            last = (float(theta[min(wanted, len(theta)) - 1]) - bounds[g][0]) / bounds[g][1]
            if g not in over:  # the degree that should do, if the residual falls as the filter says
                turns = max(turns, degree if last <= 1 else min(degree, int(np.ceil(np.arccosh(4 * max(residual[:wanted].max() / tol, 1)) / np.arccosh(last)))))

        def turned(parts, turn=turn, bounds=bounds, over=over):
            for pdf in parts:
                x, y = [], []
                for row in pdf.itertuples():
                    m, (middle, half) = len(row.ids), bounds[row.g]
                    u, v = (np.reshape(t, (m, -1)) @ turn[row.g] for t in (row.x, row.y))
                    x.append((u if row.g in over else (u - middle * v) / half).ravel())
                    y.append(v.ravel())
                pdf["x"], pdf["y"] = x, y
                yield pdf

        state = save(state.mapInPandas(turned, STATE), "vectors")
        if over:
            done.append(state.where(F.col("g").isin(list(over))))
            state, near, left = state.where(~F.col("g").isin(list(over))), near.where(~F.col("g").isin(list(over))), left - over
        if left:
            for _ in range(turns - 1):
                state = times(state, {g: (2 / h, -2 * m / h, -1.0) for g, (m, h) in bounds.items()}, False)
            state = times(state, plain)
    if left:
        raise RuntimeError(f"eigenvectors did not settle in {rounds} rounds on {points.sparkSession.sparkContext.appName}")

    def entries(parts):
        for pdf in parts:
            for row in pdf.itertuples():
                y = np.reshape(row.y, (len(row.ids), -1))[:, : None if block else len(value[row.g])]
                yield pd.DataFrame({"g": row.g, "id": row.ids, "x": list(y)})

    whole = state.limit(0) if not done else done[0]
    for more in done[1:]:
        whole = whole.union(more)
    return value, save(whole.mapInPandas(entries, "g long, id long, x array<double>"), "vectors")


def dense(xyz: np.ndarray, r: float, chunk: int = 256) -> np.ndarray:
    """The weights of all pairs of a small group."""
    a = np.empty((len(xyz),) * 2)
    for i in range(0, len(a), chunk):
        a[i : i + chunk] = weights(xyz[i : i + chunk], xyz, r)
    np.fill_diagonal(a, 0)
    return a


def placed(points: DataFrame, group: str | None, key: str, more: list[str] = ()) -> DataFrame:
    """g, id, x, y, z and the columns `more`: each id of a group once. Null ids and groups and bad coordinates go."""
    g = F.lit(0).cast("long") if group is None else F.col(group).cast("long")
    p = graph.finite(points).select(g.alias("g"), F.col(key).cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in "xyz"), *more)
    return save(p.where("g IS NOT NULL AND id IS NOT NULL").groupBy("g", "id").agg(F.min(F.struct(*"xyz", *more)).alias("p")).select("g", "id", "p.*"), "points")


def sized(points: DataFrame, group: str, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(points of the groups of at most `most` points, points of the others), as placed()."""
    p = placed(points, group, key)
    large = p.groupBy("g").count().where(F.col("count") > most).select("g")
    return p.join(large, "g", "left_anti"), p.join(large, "g", "left_semi")


def linked(pdf: pd.DataFrame, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, weights) of a small group's points that have a link, by id."""
    pdf = pdf.sort_values("id")
    a = dense(pdf[["x", "y", "z"]].to_numpy(float), r)
    some = a.any(1)
    return pdf.id.to_numpy()[some], a if some.all() else a[np.ix_(some, some)]


def spectral_clusters(points: DataFrame, group: str, r: float, n_clusters: int, key: str = "point_id", max_nodes: int = 5000, max_rows: int = 10_000_000, **settings) -> DataFrame:
    """group, id, cluster of each group's points that have a link, as cluster.spectral_clusters() for the edges. A group of at
    most `max_nodes` points is one dense matrix in one task; the vectors of larger ones are found by blocks, and one task
    holds their n_clusters entries a point for k-means (more than `max_rows` points in a group raise)."""
    out = f"{group} long, id long, cluster long"
    small, large = sized(points, group, key, max_nodes)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, a = linked(pdf, r)
        k = min(n_clusters, len(ids))
        if not k:
            return pd.DataFrame({group: [], "id": [], "cluster": []})
        _, v = cluster.spectral_embedding(a, k)
        return pd.DataFrame({group: pdf.g.iloc[0], "id": ids, "cluster": cluster.weighted_kmeans(v, k, iters=20, in_iters=32)})

    def assigned(pdf: pd.DataFrame) -> pd.DataFrame:
        cluster.bounded(len(pdf), max_rows, "points")
        pdf = pdf.sort_values("id")
        v = cluster.unit_rows(np.stack(pdf.x.tolist()))
        return pd.DataFrame({group: pdf.g, "id": pdf.id, "cluster": cluster.weighted_kmeans(v, v.shape[1], iters=20, in_iters=32)})

    got = small.groupBy("g").applyInPandas(whole, out)
    if large.isEmpty():
        return got
    _, v = eigenvectors(large, r, n_clusters, "g", "id", **settings)
    return got.union(v.groupBy("g").applyInPandas(assigned, out))


def spectral_graph(points: DataFrame, r: float, n_clusters: int, tau: float = 0.01, iters: int = 20, in_iters: int = 32, key: str = "point_id", fine: int = 10, many: int = 50_000, **settings) -> DataFrame:
    """id, cluster: all points that have a link as one graph of any size, by balanced k-means over the rows of its first
    eigenvectors, made unit vectors; as spectral.spectral_clusters() for the edges.

    Over `many` points start from the vectors of their cells of side r / `fine`, each a point of that mass, if these are a
    quarter of the points at most. What the points' vectors have to reach is the same."""
    p = placed(points, None, key)
    n, width, begin = p.count(), n_clusters + settings.setdefault("extra", 8), None
    settings.setdefault("rows", max(8192, min(65536, n // 20)))  # a block travels to some twenty others, not more
    if n > many:
        cell = [F.floor(F.col(c) / F.lit(r / fine)).alias(f"c{c}") for c in "xyz"]
        cells = save(p.groupBy(*cell).agg(F.min("id").alias("id"), *(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("mass")), "cells")
        if cells.count() <= n / 4:
            _, u = eigenvectors(cells, r, n_clusters, None, "id", mass="mass", block=True, **settings | {"tol": max(settings.get("tol", 0), 5e-3)})
            found = u.first()
            if found is not None and len(found.x) == width:
                u = u.join(cells, "id").select("cx", "cy", "cz", F.transform(u.x, lambda t: t / F.sqrt("mass")).alias("begin"))
                p = p.select("*", *cell).join(u, ["cx", "cy", "cz"], "left")
                p, begin = p.withColumn("begin", F.coalesce("begin", F.array_repeat(F.lit(float("nan")), width))), "begin"
    value, v = eigenvectors(p, r, n_clusters, None, "id", begin=begin, **settings)
    if not value:
        return v.select("id", F.lit(None).cast("long").alias("cluster"))
    x = spectral.columns(len(value[0]))
    length = F.greatest(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, t: s + t * t)), F.lit(1e-12))
    rows = save(v.select("id", *((F.col("x")[i] / length).alias(c) for i, c in enumerate(x))), "rows")
    return clouds.balanced_kmeans(rows, n_clusters, iters, in_iters, tau, False, "id", tuple(x))


def cluster_and_merge(points: DataFrame, conf: DataFrame, group: str, r: float, n_clusters: int, t: float = 0.5, key: str = "point_id", **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, cluster; id, merged; merged, conf) of points that are their own segments, as cluster.cluster_and_merge() for the
    edges: mean weights between clusters are sums over blocks too."""
    labels = save(spectral_clusters(points, group, r, n_clusters, key, **settings).withColumnRenamed(group, "g"), "labels")
    state, near = in_blocks(points, group, r, key)
    of = state.select("g", "block", F.posexplode("ids").alias("at", "id")).join(labels, ["g", "id"], "left")
    hot = F.transform(F.sequence(F.lit(0), F.lit(n_clusters - 1)), lambda i: F.when(F.col("cluster") == i, F.lit(1.0)).otherwise(F.lit(0.0)))
    of = of.groupBy("g", "block").agg(F.sort_array(F.collect_list(F.struct("at", hot.alias("hot")))).alias("m"))
    state = save(state.drop("x").join(of.select("g", "block", F.flatten("m.hot").alias("x")), ["g", "block"]).withColumn("root", F.transform("ids", lambda i: F.lit(1.0))).select("g", "block", "ids", "c", "root", "x", "y"), "labels")

    def sums(key, own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        hot = np.reshape(own.x.iloc[0], (-1, n_clusters))
        return pd.DataFrame([(int(key[0]), sum((hot.T @ s.reshape(len(hot), -1)).ravel() for s in pdf.s))], columns=["g", "s"])

    parts = products(state, near, r, links=True).groupBy("g", "block")
    m = state.groupBy("g", "block").cogroup(parts).applyInPandas(sums, "g long, s array<double>").groupBy("g").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    i, j = F.floor(F.col("at") / (2 * n_clusters)), F.col("at") % (2 * n_clusters)
    total = m.select("g", F.posexplode("s").alias("at", "w")).select("g", i.alias("i"), j.alias("j"), "w").where("i <> j")
    mean = total.where(F.col("j") < n_clusters).join(total.select("g", "i", (F.col("j") - n_clusters).alias("j"), F.col("w").alias("n")), ["g", "i", "j"])
    name = lambda c: (F.col("g") * n_clusters + F.col(c)).cast("long")
    between = mean.where("i < j AND n > 0").select(name("i").alias("src"), name("j").alias("dst"), (F.col("w") / (F.col("n") + segments.EPS)).alias("w"))
    named = labels.select("id", "g", "cluster", name("cluster").alias("name"))
    merged = graph.merge_by_threshold(named.select(F.col("name").alias("id")).distinct(), between, t).withColumnsRenamed({"id": "was", "cluster": "merged"})
    of = save(named.join(merged, F.col("name") == F.col("was")).select("id", "cluster", "merged"), "merged")
    scores = segments.cluster_confidence(of.select("id", F.col("merged").alias("cluster")), conf).withColumnRenamed("cluster", "merged")
    every = points.select(F.col(key).alias("id")).join(of, "id", "left")
    return every.select("id", "cluster"), every.select("id", "merged"), scores


def laplacian(xyz: np.ndarray, r: float, strips: list[np.ndarray] | bands.Filed, side: int = 512, chunk: int = 256) -> int:
    """The number of points that have a link; adds the lower half of their normalised Laplacian to `strips` as bands.to_band()
    takes it."""
    sums = np.zeros(len(xyz))
    for i in range(0, len(xyz), chunk):
        w = weights(xyz[i : i + chunk], xyz[i:], r)
        w[np.arange(len(w)), np.arange(len(w))] = 0
        sums[i : i + chunk] += w.sum(1)
        sums[i + len(w) :] += w[:, len(w) :].sum(0)
    xyz, sums = xyz[sums > 0], sums[sums > 0]
    root = 1 / np.sqrt(np.maximum(sums, 1e-5))
    for i in range(0, len(xyz), side):
        strip = np.empty((len(xyz) - i, min(side, len(xyz) - i)))
        for j in range(0, len(strip), chunk):
            strip[j : j + chunk] = weights(xyz[i + j : i + j + chunk], xyz[i : i + side], r) * -root[i + j : i + j + chunk, None] * root[i : i + side]
        strip[np.arange(strip.shape[1]), np.arange(strip.shape[1])] = 1
        strips.append(strip)
    return len(xyz)


def eigengaps(points: DataFrame, group: str, r: float, key: str = "point_id", max_nodes: int | None = None, held: int = 20_000) -> DataFrame:
    """group, rank, value, gap: all eigenvalues of each group's normalised Laplacian and the step to the next. A group is half
    a matrix in a task of its own, made from its points, and values alone are asked for. Up to `held` points (1.6 GB) the half
    is in memory, beyond in files of the task's temp folder, of which a strip of 512 columns is read at a time. Time is the
    cube of a group. With `max_nodes`, more points in it raise."""

    def run(parts):
        for pdf in parts:
            for g, x, y, z in pdf.itertuples(index=False):
                cluster.bounded(len(x), max_nodes or len(x), "points")
                with tempfile.TemporaryDirectory(prefix="strips-") as folder:
                    large = len(x) > held
                    strips = bands.Filed(folder) if large else []
                    if not laplacian(np.column_stack((x, y, z)), r, strips):
                        continue
                    value = bands.values(strips, bands.WIDTH * (4 if large else 1))
                yield pd.DataFrame({group: g, "rank": range(len(value)), "value": value, "gap": np.append(np.diff(value), 0.0)})

    of = placed(points, group, key).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y", "z"))).alias("m"))
    of = save(of.select("g", *(F.col(f"m.{c}").alias(c) for c in "xyz")), "groups")
    # By range each of the groups, which are few rows, has a task; by hash some would share one.
    of = of.repartitionByRange(max(1, min(of.count(), 2000)), "g")
    return of.mapInPandas(run, f"{group} long, rank int, value double, gap double")
