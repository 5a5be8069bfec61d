"""Farthest points, transport and balanced k-means over groups of any size.

What grows with the data (points, rows of scores) stays in tables that tasks read in batches; what a round has to know of
the rest is small and goes along with it: the points picked so far, the centres, one potential a column. A round is one
pass, whose tasks return sums or maxima, not rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrain.operators import graph
from scenegrain.sources.tables import save, shared_dir

# ---- farthest points


@dataclass
class Unit:
    """Points of one group in one block: their box, and the largest distance (squared) to the picks as far as it is known,
    which bounds the present one from above; `exact` if it is the present one, of the point `best`."""

    lo: np.ndarray
    hi: np.ndarray
    most: float = np.inf
    exact: bool = False
    best: tuple = ()

    def farther(self, at: np.ndarray) -> bool:
        """Whether every point of the box is at least as far from `at` as `most` says already."""
        gap = np.maximum(0, np.maximum(self.lo - at, at - self.hi))
        return float((gap * gap).sum()) * (1 - 1e-12) > self.most


def in_blocks(points: DataFrame, group: str, key: str, coords: list[str], block_points: int) -> tuple[DataFrame, int]:
    """(g, id, coordinates, block), written by block: neighbours in the order of a coarse grid share blocks."""
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")) for c in coords]
    ok = F.col(group).isNotNull() & F.col(key).isNotNull()
    for f in finite:
        ok &= f
    names = [f"v{i}" for i in range(len(coords))]
    p = points.where(ok).select(F.col(group).alias("g"), F.col(key).alias("id"), *(F.col(c).cast("double").alias(n) for c, n in zip(coords, names)))
    p = save(p, "cloud")
    n = max(1, -(-p.count() // block_points))
    if n == 1:
        return p.withColumn("block", F.lit(0)), n
    side = p.agg(*(F.min(c).alias(f"lo{c}") for c in names[:3]), *(F.max(c).alias(f"hi{c}") for c in names[:3])).first()
    cell = [F.floor((F.col(c) - side[f"lo{c}"]) / max(side[f"hi{c}"] - side[f"lo{c}"], 1e-300) * 1023).cast("long") for c in names[:3]]
    order = sum((F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), len(cell) * b + i) for b in range(10) for i, c in enumerate(cell)), F.lit(0).cast("long"))
    dealt = p.withColumn("z", order).repartitionByRange(n, "g", "z").withColumn("block", F.spark_partition_id()).drop("z")
    path = f"{shared_dir(points.sparkSession)}/scenegrain/blocks-{uuid.uuid4().hex}"
    dealt.write.partitionBy("block").parquet(path)
    return points.sparkSession.read.schema(dealt.schema).parquet(path), n


def farthest_points(
    points: DataFrame,
    group: str,
    k: int,
    centre: bool = False,
    key: str = "point_id",
    coords: tuple[str, ...] = ("x", "y", "z"),
    block_points: int = 100_000,
    at_once: int = 64,
    with_coords: bool = False,
) -> DataFrame:
    """group, rank, point_id, dist: up to k points of each group, each the farthest from those before it.

    The first is the one with the smallest id, at distance 0, or with `centre` the farthest from the centroid, which then
    counts as picked, too. Ties go by id; where all points are picked or equal to picked ones, the smallest id comes again
    until there are as many as points. Rows with a null id, group or coordinate or a non-finite one take no part; repeated
    rows are points of their own. No points give no rows.

    A group may be a whole cloud: points lie in blocks, and a round reads only blocks that may hold the farthest point, by
    bounds that the driver keeps for each group and block. The number of groups and blocks and of picks must fit the driver.
    """
    spark, names = points.sparkSession, [f"v{i}" for i in range(len(coords))]
    p, n_blocks = in_blocks(points, group, key, list(coords), block_points)
    kind = p.schema["g"].dataType.simpleString()
    sides = p.groupBy("g", "block").agg(F.count("*").alias("n"), F.min(F.struct("id", *names)).alias("first"), *(f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max, F.sum)))
    units, sizes, first, total = {}, {}, {}, {}
    for r in sides.collect():  # a row for each group and block
        units[r.g, r.block] = Unit(np.array([r[f"min_{c}"] for c in names]), np.array([r[f"max_{c}"] for c in names]))
        sizes[r.g] = sizes.get(r.g, 0) + r.n
        first[r.g] = min(first.get(r.g, r["first"]), r["first"])
        total[r.g] = total.get(r.g, 0) + np.array([r[f"sum_{c}"] for c in names])
    own: dict = {}
    for g, b in units:
        own.setdefault(g, []).append(b)
    picks = {g: ([total[g] / sizes[g]] if centre else [np.array(first[g][1:], float)]) for g in sizes}
    out = {g: [] if centre else [(first[g][0], 0.0, picks[g][0])] for g in sizes}

    def measure(wanted: set) -> None:
        """The present farthest point of these units."""
        seen = {g: np.array(picks[g]) for g in {g for g, _ in wanted}}

        def far(parts):
            for pdf in parts:
                for (g, b), rows in pdf.groupby(["g", "block"]):
                    if (g, b) not in wanted:
                        continue
                    x, at = rows[names].to_numpy(float), np.full(len(rows), np.inf)
                    for pick in seen[g]:
                        gap = (x - pick) ** 2
                        d = gap[:, 0]
                        for c in range(1, gap.shape[1]):
                            d = d + gap[:, c]
                        at = np.minimum(at, d)
                    ids = rows.id.to_numpy()
                    i = np.lexsort((ids, -at))[0]
                    yield pd.DataFrame([[g, b, float(at[i]), int(ids[i]), *x[i]]], columns=["g", "block", "d", "id", *names])

        read = p.where(F.col("block").isin(sorted({b for _, b in wanted}))) if n_blocks > 1 else p
        rows = read.mapInPandas(far, f"g {kind}, block int, d double, id long, " + ", ".join(f"{c} double" for c in names))
        for r in rows.groupBy("g", "block").agg(F.max(F.struct("d", (-F.col("id")).alias("minus"), *names)).alias("m")).collect():
            u = units[r.g, r.block]
            u.most, u.exact, u.best = r.m.d, True, (-r.m.minus, np.array([r.m[c] for c in names]))

    while True:
        unfinished = [g for g in sizes if len(out[g]) < min(k, sizes[g])]
        if not unfinished:
            break
        wanted = set()
        for g in unfinished:
            known = max((units[g, b].most for b in own[g] if units[g, b].exact), default=-1.0)
            unknown = sorted((b for b in own[g] if not units[g, b].exact and units[g, b].most >= known), key=lambda b: -units[g, b].most)
            wanted.update((g, b) for b in unknown[:at_once])
        if wanted:
            measure(wanted)
        for g in unfinished:
            sure = [units[g, b] for b in own[g] if units[g, b].exact]
            top = max((u.most for u in sure), default=-1.0)
            if any(not units[g, b].exact and units[g, b].most >= top for b in own[g]):
                continue
            best = min((u for u in sure if u.most == top), key=lambda u: u.best[0])
            i, at = best.best
            out[g].append((i, float(np.sqrt(top)), at))
            picks[g].append(at)
            for b in own[g]:
                units[g, b].exact = units[g, b].exact and units[g, b].farther(at)
    rows = [(g, r, int(i), d, [float(x) for x in at]) for g, found in out.items() for r, (i, d, at) in enumerate(found)]
    made = spark.createDataFrame(rows, f"g {kind}, rank int, id long, dist double, at array<double>")
    return made.select(F.col("g").alias(group), "rank", F.col("id").alias(key), "dist", *(["at"] if with_coords else []))


# ---- transport


def segment_lse(x: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log(sum(exp(x))) of each run of x; -inf of an infinitely small one."""
    m = np.maximum.reduceat(x, starts)
    safe = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, size)), starts))


def row_potentials(flat, at, starts, size, v, p, eps: float, slack: bool) -> np.ndarray:
    """Of each row of scores `flat` over columns `at`, for the columns' potentials v and the rows' log shares p."""
    y = segment_lse((flat + v[at]) / eps, starts, size)
    return eps * (p - (np.logaddexp(0, y) if slack else y))


@dataclass
class Transport:
    """Rows of scores, each an array with the numbers of its columns, and one potential a column.

    A row's potential follows from the columns' ones, so a round is one pass over the rows. `slack` adds a row and a column
    of zeros that are normalised with the others' sums, but have no potential of their own.
    """

    rows: DataFrame  # g, row, at array<int>, s array<double>, p double (logarithm of the row's share)
    v: np.ndarray  # one potential a column
    q: np.ndarray  # logarithms of the columns' shares
    eps: float
    slack: bool

    def round(self, before: np.ndarray | None) -> tuple[np.ndarray, float]:
        """(potentials of the columns for the rows' present ones, change of the rows' since `before`, or since 0)."""
        v, eps, slack = self.v, self.eps, self.slack
        n = len(v)

        def task(parts):
            top, total, moved = np.full(n, -np.inf), np.zeros(n), 0.0
            for pdf in parts:
                if not len(pdf):
                    continue
                size = pdf["at"].map(len).to_numpy()
                at, flat = np.concatenate(pdf["at"].tolist()), np.concatenate(pdf.s.tolist())
                starts, p = np.cumsum(size) - size, pdf.p.to_numpy(float)
                u = row_potentials(flat, at, starts, size, v, p, eps, slack)
                was = row_potentials(flat, at, starts, size, before, p, eps, slack) if before is not None else 0
                moved += float(np.abs(u - was).sum())
                x = (flat + np.repeat(u, size)) / eps
                m = np.full(n, -np.inf)
                np.maximum.at(m, at, x)
                new = np.maximum(top, m)
                safe = np.where(np.isfinite(new), new, 0)
                total = total * np.exp(np.where(np.isfinite(top), top - safe, 0)) + np.bincount(at, np.exp(x - safe[at]), n)
                top = new
            hit = np.flatnonzero(np.isfinite(top))
            yield pd.DataFrame({"at": np.append(hit, -1), "m": np.append(top[hit], 0.0), "z": np.append(total[hit], moved)})

        parts = self.rows.select("at", "s", "p").mapInPandas(task, "at int, m double, z double")
        # At most one row a task for each column.
        both = parts.groupBy("at").agg(F.max("m").alias("m"), F.collect_list(F.struct("m", "z")).alias("l"))
        both = both.select("at", "m", F.aggregate("l", F.lit(0.0), lambda t, x: t + x["z"] * F.exp(x["m"] - F.col("m"))).alias("z"))
        y, moved = np.full(n, -np.inf), 0.0
        for r in both.collect():
            if r["at"] < 0:
                moved = r.z
            else:
                y[r["at"]] = r.m + np.log(r.z)
        return eps * (self.q - (np.logaddexp(0, y) if slack else y)), moved

    def run(self, rounds: int, thresh: float | None) -> None:
        before = None
        for _ in range(rounds):
            new, moved = self.round(before)
            moved += float(np.abs(new - self.v).sum())
            before, self.v = self.v, new
            if thresh is not None and moved < thresh:
                break
        self.before = before


def transport(scores: DataFrame, group: str, hard: bool = False, eps: float = 1e-2, thresh: float = 1e-2, n_iters: int = 10, slack: bool = True, most_columns: int = 2_000_000) -> DataFrame:
    """group, row, col, p: entropic transport between rows and columns of each group's scores (group, row, col, s), equal
    shares; the rounds end when the potentials of all groups change by less than `thresh` in a group on average. `hard`: the
    best column of each row (p is 1) after rows and columns were normalised in turn, with a slack row and column.

    Rows are the long side: any number of them; one row's scores fit a record. Potentials of columns, one for each group and
    column, go to all tasks; more than `most_columns` raise. Pairs that lack carry nothing. Of repeated pairs the largest
    score counts; null ids and null or NaN scores are left out. Ties of the hard form go to the smaller column.
    """
    spark = scores.sparkSession
    d = scores.select(F.col(group).alias("g"), "row", "col", F.col("s").cast("double").alias("s")).where("g IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    d = save(d.groupBy("g", "row", "col").agg(F.max("s").alias("s")), "scores")
    cols = d.groupBy("g", "col").agg(F.count("*").alias("n"))
    n = cols.count()
    if n > most_columns:
        raise ValueError(f"{n} columns; their potentials go to all tasks, at most {most_columns} of them")
    cols = save(graph.dense_ids(cols, F.struct("g", "col"), "at", void=None), "columns")
    shape = cols.groupBy("g").agg(F.count("*").alias("n_cols"))
    packed = d.join(F.broadcast(cols.select("g", "col", F.col("at").cast("int").alias("at"))), ["g", "col"]).groupBy("g", "row").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("l"))
    n_rows = packed.groupBy("g").agg(F.count("*").alias("n_rows"))
    p = F.lit(0.0) if hard else F.log(1.0 / F.col("n_rows") + 1e-8)
    rows = save(packed.join(F.broadcast(n_rows), "g").select("g", "row", F.col("l.at").alias("at"), F.col("l.s").alias("s"), p.alias("p")), "rows")
    q = np.zeros(n)
    if not hard:
        for r in cols.join(shape, "g").select("at", "n_cols").collect():  # one row a column, bounded above
            q[r["at"]] = np.log(1 / r.n_cols + 1e-8)
    t = Transport(rows, np.zeros(n), q, 1.0 if hard else eps, hard and slack)
    n_groups = max(1, shape.count())
    t.run(n_iters, None if hard else thresh * n_groups)
    v, before, scale, slacked = t.v, t.before, t.eps, t.slack

    def plan(parts):
        for pdf in parts:
            if not len(pdf):
                continue
            size = pdf["at"].map(len).to_numpy()
            at, flat = np.concatenate(pdf["at"].tolist()), np.concatenate(pdf.s.tolist())
            starts = np.cumsum(size) - size
            if hard:
                x = flat + v[at]
                best = [int(at[a : a + k][x[a : a + k].argmax()]) for a, k in zip(starts, size)]
                yield pd.DataFrame({"g": pdf.g, "row": pdf.row, "at": best, "p": 1.0})
                continue
            p = pdf.p.to_numpy(float)
            u = row_potentials(flat, at, starts, size, before, p, scale, slacked) if before is not None else np.zeros(len(pdf))
            yield pd.DataFrame({"g": np.repeat(pdf.g.to_numpy(), size), "row": np.repeat(pdf.row.to_numpy(), size), "at": at, "p": np.exp((flat + np.repeat(u, size) + v[at]) / scale)})

    kinds = [d.schema[c].dataType.simpleString() for c in ("g", "row")]
    got = rows.mapInPandas(plan, f"g {kinds[0]}, row {kinds[1]}, at int, p double")
    names = F.broadcast(cols.select(F.col("at").cast("int").alias("at"), "col"))
    return got.join(names, "at").select(F.col("g").alias(group), "row", "col", "p")


# ---- balanced k-means


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def task_sums(rows: DataFrame, f, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of f(x), an array of `shape` for a batch of rows of coordinates."""
    names = rows.columns

    def task(parts):
        total = np.zeros(shape)
        for pdf in parts:
            if len(pdf):
                total += f(pdf[names].to_numpy(float))
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"at": at, "v": flat[at]})

    out = np.zeros(int(np.prod(shape)))
    for r in rows.mapInPandas(task, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out.reshape(shape)


def balanced_kmeans(points: DataFrame, n: int, iters: int = 10, in_iters: int = 5, tau: float = 0.01, cosine: bool = False, key: str = "point_id", coords: tuple[str, ...] = ("x", "y", "z"), block_points: int = 100_000) -> DataFrame:
    """key, cluster: one cloud of any size in n balanced clusters (fewer if it has fewer points).

    Centres start at the points farthest from the centroid and from each other. In each round potentials of the n clusters
    balance the assignment by `in_iters` passes over the points, with a slack row and column, and the centres become the
    means of their points. Scores are distances, shifted by their mean, over tau; or cosines of rows and centres made unit
    vectors. Points with a null id or bad coordinate have no row. A round's state is n centres and n potentials.
    """
    names = [f"v{i}" for i in range(len(coords))]
    whole = points.withColumns({"g_": F.lit(0)})
    start = farthest_points(whole, "g_", n, True, key, coords, block_points, with_coords=True).orderBy("rank").collect()
    ok = F.col(key).isNotNull()
    for c in coords:
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    p = save(points.where(ok).select(F.col(key).alias("id"), *(F.col(c).cast("double").alias(m) for c, m in zip(coords, names))), "cloud")
    if not start:
        return p.select(F.col("id").alias(key), F.lit(None).cast("long").alias("cluster"))
    mu, rows = np.array([r["at"] for r in start]), p.select(*names)
    size, m = p.count(), len(start)

    def distances(x, mu):
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (mu**2).sum(1) - 2 * x @ mu.T, 0))

    label, centres = None, np.zeros(0)
    for _ in range(iters):
        if cosine:
            mu = unit_rows(mu)
            score = lambda x, mu=mu: unit_rows(x) @ mu.T
            seen = unit_rows
        else:
            mean = float(task_sums(rows, lambda x, mu=mu: distances(x, mu).sum(keepdims=True).ravel(), (1,))[0]) / (size * m)
            score = lambda x, mu=mu, mean=mean: (mean - distances(x, mu)) / tau
            seen = lambda x: x
        v = np.zeros(m)
        for _ in range(in_iters):

            def columns(x, v=v, score=score):
                # A row's entries after its own normalising are at most 1, so their sums need no shift.
                y = score(x) + v
                top = np.maximum(y.max(1, keepdims=True), 0)
                u = top[:, 0] + np.log(np.exp(-top[:, 0]) + np.exp(y - top).sum(1))
                return np.exp(y - u[:, None]).sum(0)

            total = task_sums(rows, columns, (m,))
            # exp(v) times the sums without it, and 1 for the slack row.
            with np.errstate(divide="ignore"):
                was, v = v, -np.logaddexp(0, np.log(total) - v)
            if np.abs(v - was).max() < 1e-13:  # further passes would repeat this one
                break
        label = lambda x, v=v, score=score: (score(x) + v).argmax(1)

        def means(x, label=label, seen=seen):
            hot = np.eye(m)[label(x)]
            return np.column_stack((hot.T @ seen(x), hot.sum(0)))

        sums = task_sums(rows, means, (m, len(names) + 1))
        new = sums[:, :-1] / (sums[:, -1:] + 1e-5)
        if new.shape == centres.shape and np.allclose(new, centres, rtol=0, atol=1e-14):
            break  # so would further rounds
        centres = mu = new

    def assign(parts):
        for pdf in parts:
            yield pd.DataFrame({"id": pdf.id, "cluster": label(pdf[names].to_numpy(float)) if len(pdf) else []})

    kind = p.schema["id"].dataType.simpleString()
    return p.mapInPandas(assign, f"id {kind}, cluster long").withColumnRenamed("id", key)
