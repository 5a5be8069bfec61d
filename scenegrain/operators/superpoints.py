"""Superpoints: a cloud is cut along the edges of a neighbour graph where normals change.

The rule is sequential: edges by rising weight join two segments if the weight is within the threshold of both (the
largest weight inside a segment plus `k` over its size); after that, segments under a least size join whatever their next
edge leads to. Here blocks of segments that lie near each other are worked on side by side, each with all edges that touch
it, in the same order. An edge is decided only when it would be decided the same way whatever other blocks do; what it
leaves undecided waits, with all that depends on it, for a later round over other blocks. Where that leaves more than half of
the edges, the next round decides the lightest ones, as many as a block holds. So the result is that of the sequential rule,
and no round sees more than a block in a task. Edges too heavy to join anything are left out of the first phase, those
between large segments of the second.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.operators import graph
from scenegrain.sources.tables import save


def normal_weight(prefix_a: str = "a", prefix_b: str = "b") -> Column:
    """1 - cosine of two normals; squared where the second normal points away from the first point (convex edges)."""
    at = lambda p, n: F.col(f"{p}.{n}")
    a, b = prefix_a, prefix_b
    cos = at(a, "nx") * at(b, "nx") + at(a, "ny") * at(b, "ny") + at(a, "nz") * at(b, "nz")
    away = at(b, "nx") * (at(b, "x") - at(a, "x")) + at(b, "ny") * (at(b, "y") - at(a, "y")) + at(b, "nz") * (at(b, "z") - at(a, "z"))
    w = F.lit(1.0) - cos
    return F.when(away > 0, w * w).otherwise(w)


def decide(a, b, w, known: dict, k: float, least: int | None):
    """One pass over edges in order. `known` maps segments of the block to [size, threshold]; others are foreign, of which
    `size` may be known as a lower bound. Returns (parent of each merged segment, undecided edges' places).

    Without `least`: the first phase. With it: the second, in which segments under that size join.
    """
    parent: dict[int, int] = {}
    waiting: set[int] = set()
    open_: list[int] = []

    def root(x):
        while x in parent:
            x = parent[x]
        return x

    for i in range(len(a)):
        p, q = root(a[i]), root(b[i])
        if p == q:
            continue
        sp, sq = known.get(p), known.get(q)
        ok_p, ok_q = sp[2] and p not in waiting, sq[2] and q not in waiting
        if least is None:
            if (ok_p and w[i] > sp[1]) or (ok_q and w[i] > sq[1]):
                continue  # a segment that says no to its next edge never grows again
            if not (ok_p and ok_q):
                waiting.update((p, q))
                open_.append(i)
                continue
        else:
            if sp[0] >= least and sq[0] >= least:
                continue  # sizes only grow
            if not (ok_p and ok_q):
                waiting.update(x for x, s in ((p, sp), (q, sq)) if s[0] < least)
                open_.append(i)
                continue
        keep, gone = (p, q) if p < q else (q, p)
        parent[gone] = keep
        size = sp[0] + sq[0]
        known[keep] = [size, w[i] + k / size, True]
    return {x: root(x) for x in parent}, open_


def rounds(edges: DataFrame, segments: DataFrame, k: float, least: int | None, block_edges: int):
    """(id, segment) of all that merged, as a table of changes: each round's rows rename segments of the one before.

    edges: a < b, w, u, v (the first ends, which order equal weights); segments: id, size, threshold, x, y, z.
    """
    changes, before, turn = [], None, 0
    while n := edges.count():
        blocks, late = -(-n // block_edges), None
        if blocks == 1:
            placed = segments.withColumn("block", F.lit(0).cast("long"))
        elif before is not None and n > 0.5 * before:
            # Segments that reach through all blocks wait for each other: the lightest edges of all go first, in one block.
            # Nothing comes before them, so all of them are decided.
            dealt = save(edges.repartitionByRange(blocks, "w", "u", "v").withColumn("part", F.spark_partition_id()), "edges")
            edges, late = dealt.where("part = 0").drop("part"), dealt.where("part > 0").drop("part")
            placed = segments.withColumn("block", F.lit(0).cast("long"))
        else:
            # Slabs along one axis after the other hold about the same number of segments.
            axis = "xyz"[turn % 3]
            cuts = segments.approxQuantile(axis, [(i + (0.5 if turn // 3 % 2 else 0)) / blocks for i in range(1, blocks)], 0.2 / blocks)
            low = F.lit(0).cast("long")
            placed = segments.withColumn("block", low if not cuts else F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c <= F.col(axis))).cast("long"))
            turn += 1
        before = n if late is None else None
        placed = save(placed, "placed")
        own = lambda s: placed.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "size", "threshold", "block")))
        both = edges.join(own("a"), F.col("a") == F.col("id_a")).join(own("b"), F.col("b") == F.col("id_b")).drop("id_a", "id_b")
        dealt = both.withColumn("block", F.explode(F.array_distinct(F.array("block_a", "block_b"))))

        def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
            block = int(key[0])
            pdf = pdf.sort_values(["w", "u", "v"])
            known: dict = {}
            for s in "ab":
                for x, size, t, home in zip(pdf[s].tolist(), pdf[f"size_{s}"].tolist(), pdf[f"threshold_{s}"].tolist(), pdf[f"block_{s}"].tolist()):
                    known.setdefault(x, [size, t, home == block])
            merged, open_ = decide(pdf.a.tolist(), pdf.b.tolist(), pdf.w.tolist(), known, k, least)
            left = pdf.iloc[open_]
            roots = set(merged.values())
            out = [pd.DataFrame({"kind": 0, "x": list(merged), "y": [merged[x] for x in merged], "w": 0.0, "u": 0, "v": 0, "size": 0})]
            out.append(pd.DataFrame({"kind": 1, "x": list(roots), "y": 0, "w": [known[x][1] for x in roots], "u": 0, "v": 0, "size": [known[x][0] for x in roots]}))
            inner = (left.block_a == left.block_b).astype(int)
            out.append(pd.DataFrame({"kind": 2, "x": left.a, "y": left.b, "w": left.w, "u": left.u, "v": left.v, "size": 1 + inner}))
            return pd.concat(out)

        done = save(dealt.groupBy("block").applyInPandas(work, "kind int, x long, y long, w double, u long, v long, size long"), "decided")
        change = done.where("kind = 0").select(F.col("x").alias("was"), F.col("y").alias("now"))
        grown = done.where("kind = 1").select(F.col("x").alias("id"), F.col("size").alias("new_size"), F.col("w").alias("new_threshold"))
        changes.append(change)
        segments = segments.join(change, segments.id == change.was, "left_anti").join(grown, "id", "left")
        segments = save(segments.select("id", F.coalesce("new_size", "size").alias("size"), F.coalesce("new_threshold", "threshold").alias("threshold"), "x", "y", "z"), "segments")
        # An edge between two blocks is open only if both leave it open; an inner one is there once and counts as two.
        left = done.where("kind = 2").groupBy(F.col("x").alias("a"), F.col("y").alias("b"), "w", "u", "v").agg(F.sum("size").alias("n")).where("n = 2")
        left = left.select("a", "b", "w", "u", "v")
        edges = save(relabelled(left if late is None else left.union(late), change), "edges")
    return changes, segments


def relabelled(edges: DataFrame, change: DataFrame) -> DataFrame:
    """Edges between the segments' present names; of several between two the first in order."""
    for s in "ab":
        c = change.select(F.col("was").alias(f"was_{s}"), F.col("now").alias(f"now_{s}"))
        edges = edges.join(c, F.col(s) == F.col(f"was_{s}"), "left").withColumn(s, F.coalesce(f"now_{s}", s)).drop(f"was_{s}", f"now_{s}")
    pair = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "u", "v")
    return pair.groupBy("a", "b").agg(F.min(F.struct("w", "u", "v")).alias("f")).select("a", "b", "f.w", "f.u", "f.v")


def named(ids: DataFrame, changes: list[DataFrame]) -> DataFrame:
    """id, segment after all changes."""
    out = ids.select("id", F.col("id").alias("segment"))
    for i, c in enumerate(changes, 1):
        out = out.join(c, out.segment == c.was, "left").select("id", F.coalesce("now", "segment").alias("segment"))
        out = save(out, "names") if i % 8 == 0 else out
    return out


def heaviest(edges: DataFrame, k: float, most: int = 100_000) -> float:
    """A weight above which no edge joins in the first phase.

    Segments have a threshold of `k` at first, and of at most `k` / 2 above the edge that joined them last. So where edges up
    to some weight of at least `k` are followed by none within `k` / 2, no heavier one joins. Looked for between
    intervals of `k` up to `most`, of which only the lightest and heaviest edge are collected."""
    if not (k > 0 and math.isfinite(k)):
        return math.inf
    at = F.floor(F.greatest(F.least(F.col("w") / k, F.lit(float(most))), F.lit(-1.0)))
    reach = float(k)
    for r in edges.groupBy(at.alias("at")).agg(F.min("w").alias("low"), F.max("w").alias("high")).orderBy("at").collect():
        if r.low > reach and r.low > reach + k / 2:
            return reach
        reach = max(reach, r.high)
    return reach


def segment_graph(points: DataFrame, edges: DataFrame, k: float = 0.01, least: int = 20, block_edges: int = 500_000) -> DataFrame:
    """point_id, segment: each point with the smallest id in its segment, from points (point_id, x, y, z) and edges (src, dst, w).

    Edges of either direction count; of several between two points the lightest. Equal weights go by the smaller, then the
    larger end. Edges with a null or NaN weight or an end that is no point, and loops, are left out; points without an edge
    are segments of their own, also under the least size, as there is nothing to join. A null point_id is in no segment
    (null). Repeated ids count once. At most about `block_edges` edges are in one task.
    """
    p = points.where("point_id IS NOT NULL").groupBy(F.col("point_id").cast("long").alias("id")).agg(*(F.min(c).alias(c) for c in "xyz"))
    coordinate = lambda c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.col(c).cast("double")).alias(c)
    p = save(p.select("id", F.lit(1).cast("long").alias("size"), F.lit(float(k)).alias("threshold"), *map(coordinate, "xyz")), "points")
    e = edges.select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b"), F.col("w").cast("double").alias("w"))
    e = e.where("src IS NOT NULL AND dst IS NOT NULL AND a <> b AND w IS NOT NULL AND NOT isnan(w)").groupBy("a", "b").agg(F.min("w").alias("w"))
    ids = p.select("id")
    e = e.join(ids.select(F.col("id").alias("a")), "a").join(ids.select(F.col("id").alias("b")), "b")
    e = save(e.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    first, segments = rounds(e.where(F.col("w") <= heaviest(e, k)), p, k, None, block_edges)
    of = save(named(ids, first), "segments")
    # Only edges of segments under the least size matter in the second phase.
    small = save(of.join(segments.where(F.col("size") < least).select(F.col("id").alias("segment")), "segment", "left_semi").select("id"), "small")
    of_small = lambda s: e.join(small, F.col(s) == F.col("id"), "left_semi")
    renamed = of.where("id <> segment").select(F.col("id").alias("was"), F.col("segment").alias("now"))
    second, _ = rounds(save(relabelled(of_small("a").union(of_small("b")), renamed), "edges"), segments, k, least, block_edges)
    of = named(of.select(F.col("segment").alias("id")).distinct(), second).withColumnsRenamed({"id": "was", "segment": "now"}).join(of, F.col("was") == of.segment)
    return points.select("point_id").distinct().join(of.select("id", F.col("now").alias("segment")), F.col("point_id") == F.col("id"), "left").select("point_id", "segment")


def superpoints(points: DataFrame, k: int = 50, r: float = 0.05, threshold: float = 0.01, least: int = 20, block_edges: int = 500_000) -> DataFrame:
    """point_id, segment: superpoints of points with normals (point_id, x, y, z, nx, ny, nz) over their k nearest neighbours,
    looked for from radius `r` on. Points with a bad coordinate have no neighbours and stay alone."""
    near = graph.nearest_neighbours(points, k, r)
    p = points.select("point_id", F.struct("x", "y", "z", "nx", "ny", "nz").alias("p"))
    a, b = (p.select(F.col("point_id").alias(i), F.col("p").alias(n)) for i, n in (("src", "a"), ("dst", "b")))
    weighted = near.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", normal_weight().alias("w"))
    return segment_graph(points, weighted, threshold, least, block_edges)
