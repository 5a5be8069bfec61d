"""Aggregates, rankings and label joins over points, segments and masks."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.operators import graph
from scenegrain.operators.names import free_names
from scenegrain.sources.tables import save

EPS = 1e-6


def valid_groups(points: DataFrame, key: str, least: int) -> DataFrame:
    return points.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def mask_coverage(points: DataFrame, hits: DataFrame, seg: str = "spt_id", mask: str = "mask_id") -> DataFrame:
    """seg, mask, cnt, frac: points of a segment in a mask, over all of the segment's points (seen or not)."""
    n = points.groupBy(seg).agg(F.count("*").alias("n"))
    c = hits.join(points.select("point_id", seg), "point_id").groupBy(seg, mask).agg(F.count("*").alias("cnt"))
    return c.join(n, seg).select(seg, mask, "cnt", (F.col("cnt") / (F.col("n") + EPS)).alias("frac"))


def top_per_mask(cov: DataFrame, k: int = 10, seg: str = "spt_id", mask: str = "mask_id") -> DataFrame:
    w = Window.partitionBy(mask).orderBy(F.desc("frac"), seg)
    return cov.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def vector_sum(vec: str) -> Column:
    """Sum of array columns by position, one buffer a group: rows aren't exploded, and partial sums meet before a shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(vec).cast("array<double>"))))


def unit_rows(sums: DataFrame, key: str, scale: Column) -> DataFrame:
    """key, pos, val from sums `_s`: divided by `scale`, then of unit length; a zero vector stays."""
    m = sums.select(key, F.transform("_s", lambda x: x / scale).alias("_m"))
    norm = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda a, x: a + x * x))
    m = m.withColumn("_n", norm).select(key, F.posexplode("_m").alias("pos", "_x"), "_n")
    return m.select(key, "pos", (F.col("_x") / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)).alias("val"))


def mean_vectors(df: DataFrame, key: str, vec: str, weight_eps: float = EPS) -> DataFrame:
    """key, pos, val: the sum of the vectors over (count + eps), long form, of unit length over each key. Null vectors
    don't count; vectors of a key have one length."""
    s = df.where(F.col(vec).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"), vector_sum(vec).alias("_s"))
    return unit_rows(s, key, F.col("_c") + weight_eps)


def as_arrays(long: DataFrame, key: str, out: str = "feat") -> DataFrame:
    """One array a key, by position."""
    return long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("_a")).select(key, F.transform("_a", lambda x: x["val"]).alias(out))


def point_features(hits: DataFrame, visible: DataFrame, masks: DataFrame) -> DataFrame:
    """point_id, pos, val: features of all covering masks of a point, summed, over the number of its visible frames."""
    frames = visible.groupBy("point_id").agg(F.countDistinct("frame_id").alias("seen"))
    f = hits.join(masks.where("feat IS NOT NULL"), ["frame_id", "mask_id"])
    return unit_rows(f.groupBy("point_id").agg(vector_sum("feat").alias("_s")).join(frames, "point_id"), "point_id", F.col("seen"))


def segment_confidence(cov: DataFrame, scores: DataFrame, seg: str = "spt_id") -> DataFrame:
    g = cov.join(scores, "mask_id").groupBy(seg).agg(F.sum(F.col("frac") * F.col("score")).alias("a"), F.sum("frac").alias("b"))
    return g.select(seg, F.greatest(F.lit(0.0), F.col("a") / (F.col("b") + EPS)).alias("conf"))


def pair_blocks(n: DataFrame, mean: float, heavy: int, pairs: float) -> tuple[DataFrame, int]:
    """(n with `at`: the rank of g, `blk`: numbers of neighbouring ranks with about `pairs` pairs together, if a member makes
    `mean` pairs, `parts` of a block; the number of blocks). A group of over `heavy` items is a block of its own in several
    parts."""
    n = graph.dense_ids(n, "g", "at", void=None).withColumn("at", F.col("at").cast("int"))
    far, parts = F.floor(F.col("at") / 4096), F.when(F.col("size") > heavy, F.ceil(F.col("size") / heavy)).otherwise(F.lit(1)).cast("int")
    w = Window.partitionBy(far).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    n = n.withColumn("parts", parts).withColumn("heavy", (F.col("parts") > 1).cast("int"))
    # Blocks rise with ranks: a heavy group ends a run of others.
    n = n.withColumn("b", F.struct(far.alias("far"), F.floor(before(F.least("size", F.lit(heavy))) * mean / pairs).alias("step"), (2 * before("heavy") + F.col("heavy")).alias("run"))).drop("heavy")
    n = save(n.select("*", "b.*").drop("b"), "ranks")
    found = sorted(tuple(r) for r in n.select("far", "step", "run").distinct().collect())
    blocks = n.sparkSession.createDataFrame([(*b, k) for k, b in enumerate(found)], "far long, step long, run long, blk int")
    return n.join(F.broadcast(blocks), ["far", "step", "run"]).drop("far", "step", "run"), max(1, len(found))


def relation_matrix(members: DataFrame, group: str, item: str, weights: DataFrame | None = None, most: int = 1024, heavy: int = 100_000, pairs: float = 4e6) -> DataFrame:
    """i, j, inter, iou, precision, recall of every two groups that share an item (also with themselves).

    Groups lie in blocks of neighbouring keys with about `pairs` pairs each. An item sends each block that has some of its
    groups those and the ones behind them, once, so i <= j, and a block's pairs are made and counted in one task; counts are
    mirrored afterwards. Groups whose items are their own neighbours' cost little more than their members, others at most a
    list a member. Items of over `most` groups meet in lists, groups of over `heavy` items are dealt by j too. `weights`
    (item, weight) makes sums of weights of the counts; items without a weight count 0, so those of weight 0 can be left out
    of it. Repeated members count once; null groups and items are ignored. An item of n groups makes n * (n + 1) / 2 pairs.
    """
    m = members.select(F.col(group).alias("g"), F.col(item).alias("p")).where("g IS NOT NULL AND p IS NOT NULL").distinct()
    if weights is None:
        m = m.withColumn("w", F.lit(1).cast("long"))
    else:
        m = m.join(weights.groupBy(F.col(item).alias("p")).agg(F.sum("weight").alias("w")), "p")
    m = save(m, "members")
    per = m.groupBy("p").agg(F.count("*").alias("size"))
    some = per.agg(F.sum(F.col("size") * (F.col("size") + 1) / 2).alias("pairs"), F.max("size").alias("size"), F.sum("size").alias("members")).first()
    pairs = min(pairs, max(pairs / 8, (some["pairs"] or 0) / (2 * m.sparkSession.sparkContext.defaultParallelism)))  # few pairs in smaller blocks
    n, blocks = pair_blocks(m.groupBy("g").agg(F.sum("w").alias("n"), F.count("*").alias("size")), (some["pairs"] or 0) / (some["members"] or 1), heavy, pairs)
    ends = n.count()
    m, crowded = graph.with_few(m, n.select("g", "at", "blk", "parts"), ends, ["g"], 500_000), (some["size"] or 0) > most
    by = ["p"]
    if crowded:
        hot = save(per.where(F.col("size") > most).select("p", F.ceil(F.col("size") / most).alias("lists")), "hot")
        m, by = graph.with_few(m, hot, hot.count(), ["p"]).withColumn("list", F.pmod(F.xxhash64("g"), F.coalesce("lists", F.lit(1))).cast("int")), ["p", "list"]
    lists = m.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("at", "blk", "parts"))).alias("m"), F.max("w").alias("w"))
    lists = lists.select(*by, "w", *(F.col(f"m.{c}").alias(c) for c in ("at", "blk", "parts")))
    # A row for each run of a block in the list: where it starts and ends.
    runs = lambda d: d.select("*", F.posexplode("blk").alias("start", "b")).where("start = 0 OR b <> blk[start - 1]").withColumn("own", F.size(F.filter("blk", lambda x: x == F.col("b"))))
    behind = lambda c, start: F.slice(c, start, F.size(c))
    sent = runs(lists).select("w", "b", F.slice("at", F.col("start") + 1, F.col("own")).alias("own"), behind("at", F.col("start") + F.col("own") + 1).alias("js"), F.col("parts")[F.col("start")].alias("parts"), F.lit(True).alias("inner"))
    if crowded:
        lists = save(lists.join(hot.select("p"), "p", "left_semi"), "lists")
        far = runs(lists).join(lists.select("p", F.col("list").alias("other"), F.col("at").alias("js")), "p").where("list <> other")
        own = far.select("w", "b", F.slice("at", F.col("start") + 1, F.col("own")).alias("own"), "js", F.col("parts")[F.col("start")].alias("parts"))
        sent = sent.union(own.select("w", "b", "own", F.filter("js", lambda j: j > F.col("own")[0]).alias("js"), "parts", F.lit(False)).where(F.size("js") > 0))
    dealt = F.filter("js", lambda j: F.pmod(F.xxhash64(j), F.col("parts")) == F.col("part"))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("w", "b", "part", "own", F.when(F.col("parts") == 1, F.col("js")).otherwise(dealt).alias("js"), (F.col("inner") & (F.col("part") == 0)).alias("inner"))
    to = F.when(F.col("part") == 0, F.col("b")).otherwise(F.pmod(F.xxhash64("b", "part"), F.lit(blocks))).cast("int")
    # All pairs of equal i and j lie in one partition, so they are counted there.
    sent = sent.withColumn("to", to).repartitionById(blocks, "to")
    i = sent.select("to", "w", "own", "js", "inner", F.posexplode("own").alias("k", "i"))
    j = F.explode(F.when(F.col("inner"), F.concat(behind("own", F.col("k") + 1), "js")).otherwise(F.col("js")))
    found = i.select("to", "i", "w", j.alias("j")).where("i <= j").groupBy("to", "i", "j").agg(F.sum("w").alias("inter")).drop("to")
    name = lambda c: n.select(F.col("at").alias(c), F.col("g").alias(f"g{c}"), F.col("n").alias(f"n{c}"))
    d = graph.with_few(graph.with_few(found, name("i"), ends, ["i"], 500_000), name("j"), ends, ["j"], 500_000)
    side = lambda i, j: F.struct(F.col(f"g{i}").alias("i"), F.col(f"g{j}").alias("j"), F.col(f"n{i}").alias("ni"), F.col(f"n{j}").alias("nj"))
    both = F.when(F.col("i") == F.col("j"), F.array(side("i", "j"))).otherwise(F.array(side("i", "j"), side("j", "i")))
    d = d.select("inter", F.explode(both).alias("s")).select("inter", "s.*")
    return d.select("i", "j", "inter", (F.col("inter") / (F.col("ni") + F.col("nj") - F.col("inter") + EPS)).alias("iou"), (F.col("inter") / (F.col("nj") + EPS)).alias("precision"), (F.col("inter") / (F.col("ni") + EPS)).alias("recall"))


def cluster_edges(edges: DataFrame, labels: DataFrame, how: str = "mean") -> DataFrame:
    """ci, cj, w between clusters (ci <= cj): mean weight of edges above 0 over both directions, or the largest weight."""
    e = edges.where("w > 0").select("src", "dst", "w")
    e = e.union(e.select("dst", "src", "w"))
    a, b = labels.select(F.col("id").alias("src"), F.col("cluster").alias("ci")), labels.select(F.col("id").alias("dst"), F.col("cluster").alias("cj"))
    d = e.join(a, "src").join(b, "dst").where("ci <= cj")
    return d.groupBy("ci", "cj").agg((F.sum("w") / (F.count("*") + EPS) if how == "mean" else F.max("w")).alias("w"))


def cluster_confidence(labels: DataFrame, conf: DataFrame) -> DataFrame:
    g = labels.join(conf, "id").groupBy("cluster").agg((F.sum("conf") / (F.count("*") + EPS)).alias("c"))
    return g.select("cluster", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c"))).alias("conf"))


def softmax(df: DataFrame, key: str, logit: str, out: str = "p") -> DataFrame:
    """Adds `out`, each row's share among the rows of its key; a column of that name is replaced."""
    w = Window.partitionBy(key)
    (e,) = free_names(df, "e")
    d = df.withColumn(e, F.exp(F.col(logit) - F.max(logit).over(w)))
    return d.withColumn(out, F.col(e) / F.sum(e).over(w)).drop(e)


def argmax(df: DataFrame, key: str, cls: str, score: str) -> DataFrame:
    """The class of the largest score; the smallest class of equal ones."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(cls)).alias("c")))
    return df.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.c")).alias(cls), F.col("b.s").alias(score))


def resolve_masks(hits: DataFrame, scores: DataFrame, item: str, threshold: float | None = None, items: DataFrame | None = None) -> DataFrame:
    """The best mask of each item (smallest id of equal ones); with a threshold all of the best score or above it. With
    `items`, those that no mask covers come too, with nulls."""
    if items is not None:
        return items.select(item).join(resolve_masks(hits, scores, item, threshold), item, "left")
    d = hits.join(scores, "mask_id")
    if threshold is None:
        return d.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("score"), "mask_id"))).where("_r = 1").drop("_r")
    return d.withColumn("_r", F.rank().over(Window.partitionBy(item).orderBy(F.desc("score")))).where((F.col("_r") == 1) | (F.col("score") > threshold)).drop("_r")


def gmm(df: DataFrame, cluster: str, weight: str, dims: list[str]) -> DataFrame:
    """Weight share, means and isotropic variance of each cluster of weighted points."""
    w = F.col(weight)
    s = df.groupBy(cluster).agg(F.sum(w).alias("sw"), F.count("*").alias("n"), *(F.sum(w * F.col(c)).alias(f"s_{c}") for c in dims), F.sum(w * sum((F.col(c) * F.col(c) for c in dims[1:]), F.col(dims[0]) * F.col(dims[0]))).alias("sq"))
    total = df.agg(F.count("*").alias("total"))
    d = s.crossJoin(F.broadcast(total)).withColumn("npi", F.col("sw") + 1e-5)
    mu = [(F.col(f"s_{c}") / F.col("npi")).alias(f"mu_{c}") for c in dims]
    m2 = sum(((F.col(f"s_{c}") / F.col("npi")) * (F.col(f"s_{c}") / F.col("npi")) for c in dims[1:]), (F.col(f"s_{dims[0]}") / F.col("npi")) * (F.col(f"s_{dims[0]}") / F.col("npi")))
    return d.select(cluster, (F.col("sw") / F.col("total")).alias("pi"), *mu, (F.col("sq") / F.col("npi") - m2 * (2 - F.col("sw") / F.col("npi"))).alias("var"))


def first_match(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    cols = [c for c in df.columns if c != key and c not in order]
    g = df.groupBy(key).agg(F.min(F.struct(*order, *cols)).alias("_f"))
    return g.select(key, *(F.col(f"_f.{c}").alias(c) for c in order + cols))


def last_writer(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.struct(*order, value)).alias("_l")).select(key, F.col(f"_l.{value}").alias(value))


def lookup(df: DataFrame, key: str, vocab: DataFrame, vkey: str, value: str, default, order: list[str] | None = None) -> DataFrame:
    """`value` of the first row of the vocabulary with the key, by `order` (or the least value), or the default."""
    k, v = (f"{c}_of_{value}" for c in ("key", "first"))  # names of their own
    first = F.min(F.struct(*(order or []), value))[value]
    few = vocab.groupBy(F.col(vkey).alias(k)).agg(first.alias(v))
    return df.join(few, F.col(key) == F.col(k), "left").withColumn(value, F.coalesce(v, F.lit(default))).drop(k, v)


def revise_labels(gt: DataFrame, probs: DataFrame, key: str, t: float = 0.6) -> DataFrame:
    best = argmax(probs, key, "cls", "p")
    return gt.join(best, key, "left").select(key, F.when(F.col("p") > t, F.col("cls")).otherwise(F.col("label")).alias("label"))


def detections(found: DataFrame, threshold: float = 0.4, name: str = "name", score: str = "score") -> DataFrame:
    """The detections strictly above the threshold, as detection pipelines keep them, labels closed by a full stop as the
    detector's prompts are; null scores go."""
    closed = F.when(F.col(name).endswith("."), F.col(name)).otherwise(F.concat(F.col(name), F.lit(".")))
    return found.where(F.col(score) > threshold).withColumn(name, closed)
