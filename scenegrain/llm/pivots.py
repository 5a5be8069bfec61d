"""Near-duplicate vectors by a complete pivot-permutation index.

Unit vectors are mixed by an isometry and cut into S sections. Each section has reference points (pivots): a bounded
sample, spread apart, so a dense group gets few of them. Of two vectors at the cosine or above, whose distance is at most
D, two sections at least are no farther apart than `reach` = D / sqrt(S - 1): else S - 1 of them would make up more than
D. The middle of two such sections is in the cell of some pivot, and both are within reach / 2 of that cell. So a vector is
described by the pivots whose cell may be that near, nearest first, and a pair that qualifies shares pivots in two
sections at least (in one, if there is one section only). Vectors are in the inverted lists of their pivots, but for the
last section, where no pair can have its smallest shared pivot. In a list shared pivots are counted from ids alone; only
pairs that share enough, and here their smallest, are verified by their cosine in double precision. Long lists are cut
into blocks, and pairs of blocks are dealt to tasks, so there is no cap on a list. Tasks return the number of links of each
vector and a forest of them, not the links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrain.operators.graph import connected_components
from scenegrain.sources.tables import save


def n_pivots(n: int, most: int = 4096) -> int:
    """About the square root of the number of vectors, as a power of two from 64 to `most`."""
    return int(min(most, max(64, 2 ** np.ceil(np.log2(max(1, n) ** 0.5)))))


def usable(v, dims) -> F.Column:
    """Not null, without null or non-finite components, not zero."""
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (dims > 0) & finite & F.exists(v, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sections(x: np.ndarray, width: int = 16) -> list[np.ndarray]:
    """Unit rows under an isometry (signs, Fourier transform, order, all fixed) that spreads what a few components hold,
    cut into sections of about `width`."""
    dim = x.shape[1]
    r = np.random.default_rng(dim)
    f = np.fft.rfft(x * r.choice((-1.0, 1.0), dim), axis=1, norm="ortho")
    twice = np.full(f.shape[1], 2**0.5)
    twice[0] = 1
    if dim % 2 == 0:
        twice[-1] = 1
    y = np.concatenate((f.real * twice, f.imag * twice), 1)
    return np.array_split(y[:, r.permutation(y.shape[1])], max(1, dim // width), axis=1)


def spread(sample: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Up to `most` rows of the sample in order, each farther than `apart` from those before it."""
    far, taken = np.ones(len(sample), bool), []
    while len(taken) < most and far.any():
        taken.append(int(far.argmax()))
        far &= ((sample - sample[taken[-1]]) ** 2).sum(1) > apart**2
    return sample[taken]


def met(x: np.ndarray, ref: np.ndarray, reach: float, nearest: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(row, pivot) for each pivot whose cell may be within reach / 2 of the row: those that are no farther than that
    beyond the bisecting plane to each of the row's nearest pivots. In order of rows, the nearest pivot first."""
    square = (ref**2).sum(1)
    d = (x**2).sum(1)[:, None] + square - 2 * x @ ref.T
    k = min(nearest, len(ref))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
    first, rows = near[:, 0], np.arange(len(x))
    gap = np.sqrt(np.maximum(square[first][:, None] + square - 2 * ref[first] @ ref.T, 0))
    i, p = np.nonzero(d - d[rows, first][:, None] <= gap * reach + 1e-9)
    for c in range(1, k):
        q = near[i, c]
        ok = d[i, p] - d[i, q] <= np.linalg.norm(ref[p] - ref[q], axis=1) * reach + 1e-9
        i, p = i[ok], p[ok]
    order = np.lexsort((d[i, p], i))
    return i[order], p[order]


def common(pivot: np.ndarray, owner: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Which pairs of rows and columns share one of these pivots; entries are (pivot, owner)."""
    sides = []
    for some in (rows, cols):
        at = np.full(int(max(owner.max(initial=-1), some.max(initial=-1))) + 1, -1)
        at[some] = np.arange(len(some))
        own = at[owner]
        sides.append((pivot[own >= 0], own[own >= 0], len(some)))
    both, out = np.intersect1d(sides[0][0], sides[1][0]), np.zeros((len(rows), len(cols)), bool)
    for k in range(0, len(both), 1024):
        some, has = both[k : k + 1024], []
        for ids, own, n in sides:
            m, hit = np.zeros((n, len(some)), np.float32), np.isin(ids, some)
            m[own[hit], np.searchsorted(some, ids[hit])] = 1
            has.append(m)
        out |= has[0] @ has[1].T > 0
    return out


def similar(x: np.ndarray, y: np.ndarray, ok: np.ndarray, cosine: float) -> np.ndarray:
    """`ok` without the pairs of unit rows below the cosine: pair by pair if few are asked for, else by a product."""
    step = max(1, (1 << 20) // x.shape[1])
    if 8 * np.count_nonzero(ok) < ok.size:
        a, b = np.nonzero(ok)
    else:
        s = x @ y.T
        ok = ok & (s >= cosine - 1e-9)
        a, b = np.nonzero(ok & (s < cosine + 1e-9))
    for k in range(0, len(a), step):
        i, j = a[k : k + step], b[k : k + step]
        ok[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
    return ok


def similar_vectors(vectors: DataFrame, cosine: float = 0.98, block: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): equal vectors of a label form a class; classes link.

    members: vec_id, node (the class, null for vectors that link with nothing); classes: node, size, low (its smallest
    vec_id, null if all are null); links: a, b, n with b <= a, rows of several tasks: a's links of the task lead to n vectors,
    and b is the smallest class that they reach there. Classes have numbers of their own, so ids may be null, repeat or be
    of any size. Vectors link only when labels are equal and not null and lengths are equal. Null, zero and non-finite ones
    link with nothing.
    """
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    ok = F.col("label").isNotNull() & usable(F.col("vec").cast("array<double>"), F.size("vec"))
    classes = d.where(ok).groupBy("label", "vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"))
    good = save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = d.join(good.select("label", "vec", "node"), ["label", "vec"], "left").select("vec_id", "node")
    p = n_pivots(good.count())
    # A sample of 4 p vectors, by hash: bounded by n_pivots(), 4 x 4096 vectors at most.
    sample = [r.vec for r in good.select(F.col("vec").cast("array<double>").alias("vec"), F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(4 * p).collect()]
    by_dim: dict[int, list] = {}
    for x in sample:
        by_dim.setdefault(len(x), []).append(x)
    pivots = {}
    for dim, x in by_dim.items():
        parts = sections(unit(np.array(x, float)))
        reach = float(np.sqrt(max(0.0, 2 - 2 * cosine) / max(1, len(parts) - 1)))
        pivots[dim] = reach, [spread(s, p, 2 * reach) for s in parts]
    # Where the pivots of each section start, and where the last one ends.
    starts = {dim: np.cumsum([0, *map(len, refs)]) for dim, (_, refs) in pivots.items()}

    def describe(parts):
        for pdf in parts:
            for dim, g in pdf.groupby("dim"):
                lists = [[] for _ in range(len(g))]
                reach, refs = pivots.get(dim, (0, []))
                if not refs:  # no vector of this length was drawn: one list
                    lists = [[0] for _ in lists]
                for s in range(0, len(g) if refs else 0, 512):
                    x, first = sections(unit(np.array(g.vec.iloc[s : s + 512].tolist(), float))), 0
                    for y, ref in zip(x, refs):
                        for i, k in zip(*map(np.ndarray.tolist, met(y, ref, reach))):
                            lists[s + i].append(first + k)
                        first += len(ref)
                last = starts[dim][-2] if len(refs) > 1 else np.inf
                listed = [sum(k < last for k in m) for m in lists]
                cols = {"label": g.label, "dim": dim, "node": g.node, "size": g["size"], "vec": g.vec, "met": lists, "listed": listed}
                yield pd.DataFrame(cols)

    kind = good.schema["vec"].dataType.simpleString()
    codes = save(good.select(F.xxhash64("label").alias("label"), F.size("vec").alias("dim"), "node", "size", "vec").mapInPandas(describe, f"label long, dim int, node long, size long, vec {kind}, met array<int>, listed int"), "codes")
    lists = codes.withColumn("pivot", F.explode(F.slice("met", F.lit(1), F.col("listed"))))
    sizes = lists.groupBy("label", "dim", "pivot").agg(F.count("*").alias("n")).where("n > 1").withColumn("n_blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    dealt = lists.join(sizes, ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select("label", "dim", "pivot", "own", "node", "size", "vec", "met", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))

    def verify(key, pdf):
        pivot, first, second = int(key[2]), key[3], key[4]
        cuts = starts.get(int(key[1]), np.array([0, 1]))
        after = cuts[np.searchsorted(cuts, pivot, "right")]  # where the next section starts
        x, node, size = None, pdf.node.to_numpy(), pdf["size"].to_numpy(float)
        flat, owner = np.concatenate(pdf.met.tolist()), np.repeat(np.arange(len(pdf)), [len(m) for m in pdf.met])
        _, of, count = np.unique(flat, return_inverse=True, return_counts=True)
        flat, owner = flat[count[of] > 1], owner[count[of] > 1]  # what one vector alone has isn't shared
        smaller, later = flat < pivot, flat >= after
        i = np.flatnonzero(pdf.own.to_numpy() == first)
        j = np.flatnonzero(pdf.own.to_numpy() == second)
        out = [pd.DataFrame({"a": np.array([], "int64"), "b": np.array([], "int64"), "n": np.array([], "int64")})]
        for part in np.array_split(i, max(1, -(-len(i) // 1024))):
            # Shared pivots: this one, none that is smaller (those pairs are verified there), one in another section.
            if len(cuts) > 2:
                ok = common(flat[later], owner[later], part, j)
            else:
                ok = np.ones((len(part), len(j)), bool)
            if first == second:
                ok &= node[part][:, None] < node[j][None, :]
            r, c = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            rows, cols = part[r], j[c]
            ok = ok[np.ix_(r, c)] & ~common(flat[smaller], owner[smaller], rows, cols)
            if not ok.any():
                continue
            x = unit(np.array(pdf.vec.tolist(), float)) if x is None else x
            ok = similar(x[rows], x[cols], ok, cosine)
            around, least, big = np.zeros(len(pdf)), node.copy(), np.iinfo(np.int64).max
            around[rows] += ok @ size[cols]
            around[cols] += size[rows] @ ok
            while True:
                before = least.copy()
                least[rows] = np.minimum(least[rows], np.where(ok, least[cols][None, :], big).min(1))
                least[cols] = np.minimum(least[cols], np.where(ok, least[rows][:, None], big).min(0))
                if (before == least).all():
                    break
            at = np.flatnonzero(around)
            out.append(pd.DataFrame({"a": node[at], "b": least[at], "n": around[at].astype("int64")}))
        return pd.concat(out)

    links = save(dealt.groupBy("label", "dim", "pivot", "first", "second").applyInPandas(verify, "a long, b long, n long"), "links")
    return members, good.select("node", "size", "low"), links


def near_vectors(vectors: DataFrame, cosine: float = 0.98, **names) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of `vectors`.

    Rows of equal vectors and label link with each other. A vector that links with nothing has n_links 0, itself as
    component_id and is kept. A null vec_id names nothing: component_id is the smallest id that isn't null, or null if there
    is none, and a row with a null id is kept only then. Rows that share an id, of equal or different vectors, are judged each
    by its own vector. Vectors of any length are compared, with those of their length. An empty table gives an empty one.
    """
    members, classes, links = similar_vectors(vectors, cosine, **names)
    around = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("around"))
    comps = connected_components(links.where("a <> b").select("a", "b").distinct(), "b", "a").withColumnRenamed("id", "node")
    known = classes.join(around, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = save(known.select("node", "component", "low", (F.col("size") - 1 + F.coalesce("around", F.lit(0))).alias("n_links")), "known")
    least = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(least, "component").select("node", "n_links", "component_id")
    out = members.join(known, "node", "left")
    first = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
