"""Queries that go in rounds: farthest points, transport, k-means, superpoints. SQL repeats the rounds one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenegrain.functions import scalar as s
from scenegrain.operators import clouds, kernel, runs, superpoints
from scenegrain.plans.registry import CLS, P_SQL, class_scores, points, q, r6
from scenegrain.sources.tables import table

# ---- farthest points


def fps_sql(k: int, centre: bool) -> str:
    """Each round: the squared distance to the nearest pick so far, then the farthest point, the smaller id in a tie."""
    to = lambda a: f"(p.x-{a}.x)*(p.x-{a}.x)+(p.y-{a}.y)*(p.y-{a}.y)+(p.z-{a}.z)*(p.z-{a}.z)"
    far = "SELECT label, arg_max(point_id, (d, -point_id)) AS point_id, max(d) AS d FROM d{} GROUP BY label"
    steps = [P_SQL]
    if centre:
        steps.append("c AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY label)")
        steps.append(f"d0 AS MATERIALIZED (SELECT p.*, {to('c')} AS d FROM p JOIN c USING (label))")
        steps.append(f"f0 AS MATERIALIZED ({far.format(0)})")
    else:
        steps.append("d0 AS MATERIALIZED (SELECT *, CAST('inf' AS DOUBLE) AS d FROM p)")
        steps.append("f0 AS MATERIALIZED (SELECT label, min(point_id) AS point_id, 0.0::DOUBLE AS d FROM p GROUP BY label)")
    for i in range(1, k):
        own = f"SELECT p.label, p.x, p.y, p.z FROM p JOIN f{i - 1} USING (label, point_id)"
        steps.append(f"d{i} AS MATERIALIZED (SELECT p.* EXCLUDE (d), least(p.d, {to('b')}) AS d FROM d{i - 1} p JOIN ({own}) b USING (label))")
        steps.append(f"f{i} AS MATERIALIZED ({far.format(i)})")
    rows = " UNION ALL ".join(f"SELECT label, {i} AS rank, point_id, d FROM f{i}" for i in range(k))
    sizes = "n AS (SELECT label, count(*) AS n FROM p GROUP BY label)"
    return f"WITH {', '.join(steps)}, {sizes} SELECT label, CAST(rank AS INTEGER) AS rank, point_id, round(sqrt(d),6) AS dist FROM ({rows}) JOIN n USING (label) WHERE rank < n"


@q("q_fps", fps_sql(16, False))
def q_fps(spark, d):
    return clouds.farthest_points(points(spark, d), "label", 16).withColumn("dist", r6("dist"))


@q("q_fps_center", fps_sql(16, True))
def q_fps_center(spark, d):
    return clouds.farthest_points(points(spark, d), "label", 16, centre=True).withColumn("dist", r6("dist"))


# ---- transport

SCORES = CLS + ", sc AS MATERIALIZED (SELECT point_id AS r, class_id AS c, logit AS s FROM lg)"
LSE = "max(e)+ln(sum(exp(e-m)))"


def lse_sql(name: str, key: str, e: str, join: str) -> str:
    """name(key, y): log of the sum of exp(e) over the pairs of scores with `key`."""
    return f"{name} AS MATERIALIZED (SELECT {key}, max(e)+ln(sum(exp(e-m))) AS y FROM (SELECT sc.{key}, {e} AS e, max({e}) OVER (PARTITION BY sc.{key}) AS m FROM {join}) GROUP BY {key})"


def transport_sql(rounds: int = 10, eps: float = 1e-2, thresh: float = 1e-2) -> str:
    n = "(SELECT count(DISTINCT {}) FROM sc)"
    p, w = (f"ln(1.0::DOUBLE/{n.format(k)}+1e-8)" for k in "rc")
    steps = [SCORES, "u0 AS (SELECT DISTINCT r, 0.0::DOUBLE AS u FROM sc)", "v0 AS (SELECT DISTINCT c, 0.0::DOUBLE AS v FROM sc)"]
    for t in range(1, rounds + 1):
        steps.append(lse_sql(f"a{t}", "r", f"(s+v)/{eps}", f"sc JOIN v{t - 1} v ON v.c=sc.c"))
        steps.append(f"u{t} AS MATERIALIZED (SELECT r, {eps}*({p}-y) AS u FROM a{t})")
        steps.append(lse_sql(f"b{t}", "c", f"(s+u)/{eps}", f"sc JOIN u{t} u ON u.r=sc.r"))
        steps.append(f"v{t} AS MATERIALIZED (SELECT c, {eps}*({w}-y) AS v FROM b{t})")
    moved = [f"SELECT {t} AS t, (SELECT sum(abs(x.u-y.u)) FROM u{t} x JOIN u{t - 1} y USING (r))+(SELECT sum(abs(x.v-y.v)) FROM v{t} x JOIN v{t - 1} y USING (c)) AS moved" for t in range(1, rounds + 1)]
    steps.append(f"stop AS MATERIALIZED (SELECT coalesce(min(t) FILTER (moved < {thresh}), {rounds}) AS t FROM ({' UNION ALL '.join(moved)}))")
    us = " UNION ALL ".join(f"SELECT {t} AS t, r, u FROM u{t}" for t in range(1, rounds + 1))
    vs = " UNION ALL ".join(f"SELECT {t} AS t, c, v FROM v{t}" for t in range(1, rounds + 1))
    return ", ".join(steps) + f' SELECT sc.r AS "row", sc.c AS col, round(exp((s+u+v)/{eps}),6) AS p FROM sc JOIN ({us}) u ON u.r=sc.r JOIN ({vs}) v ON v.c=sc.c AND v.t=u.t JOIN stop ON stop.t=u.t'


def hard_sql(rounds: int = 5) -> str:
    """Rows, then columns normalised with one more entry of 0; the column of each row with the largest score left."""
    steps = [SCORES, "w0 AS (SELECT DISTINCT c, 0.0::DOUBLE AS w FROM sc)"]
    plus_zero = "greatest(y,0)+ln(exp(y-greatest(y,0))+exp(-greatest(y,0)))"
    for t in range(1, rounds + 1):
        steps.append(lse_sql(f"a{t}", "r", "s-w", f"sc JOIN w{t - 1} w ON w.c=sc.c"))
        steps.append(f"u{t} AS MATERIALIZED (SELECT r, {plus_zero} AS u FROM a{t})")
        steps.append(lse_sql(f"b{t}", "c", "s-u", f"sc JOIN u{t} u ON u.r=sc.r"))
        steps.append(f"w{t} AS MATERIALIZED (SELECT c, {plus_zero} AS w FROM b{t})")
    return ", ".join(steps) + f' SELECT r AS "row", arg_max(sc.c, (s-w, -sc.c)) AS col, 1.0::DOUBLE AS p FROM sc JOIN w{rounds} w ON w.c=sc.c GROUP BY r'


def all_scores(spark, d):
    return class_scores(spark, d).select(F.lit(0).alias("g"), F.col("point_id").alias("row"), F.col("class_id").alias("col"), F.col("logit").alias("s"))


@q("q_sinkhorn", transport_sql())
def q_sinkhorn(spark, d):
    return clouds.transport(all_scores(spark, d), "g").drop("g").withColumn("p", r6("p"))


@q("q_sinkhorn_rpm", hard_sql())
def q_sinkhorn_rpm(spark, d):
    return clouds.transport(all_scores(spark, d), "g", hard=True, n_iters=5).drop("g")


# ---- k-means and superpoints, without SQL: held against versions for one array


@q("q_wkmeans")
def q_wkmeans(spark, d):
    return clouds.balanced_kmeans(points(spark, d), 6)


def with_normals(spark, d):
    """Points whose normals are much the same within a label."""
    lab = F.col("label").cast("double")
    normal = s.l2_normalize(F.array(F.sin(lab), F.cos(lab), 0.3 + 0.05 * F.col("feat")[4]))
    return points(spark, d).select("point_id", "x", "y", "z", *(normal[i].alias(n) for i, n in enumerate(("nx", "ny", "nz"))))


@q("q_superpoints")
def q_superpoints(spark, d):
    return superpoints.superpoints(with_normals(spark, d), k=50, r=0.1, threshold=0.01, least=20)


@q("q_spectral_graph")
def q_spectral_graph(spark, d):
    """All points as one graph, whose size has no bound."""
    return kernel.spectral_graph(points(spark, d), 0.2, 8, iters=3, in_iters=4, tol=1e-3)


# ---- masks as runs; SQL counts their pixels

WIDTH, HEIGHT = 64, 48
#: A rectangle a vector, of whole pixels of a small image; twenty vectors share a frame.
RUN_SQL = f"""r AS (
  SELECT vec_id // 20 AS frame_id, vec_id AS mask_id, abs(CAST(floor(embedding[1]::DOUBLE*100) AS BIGINT)) % 40 AS x0, abs(CAST(floor(embedding[2]::DOUBLE*100) AS BIGINT)) % 30 AS y0,
    abs(CAST(floor(embedding[3]::DOUBLE*100) AS BIGINT)) % 24 AS w, abs(CAST(floor(embedding[4]::DOUBLE*100) AS BIGINT)) % 18 AS h FROM embeddings
), px AS (
  SELECT frame_id, mask_id, x, y FROM (SELECT *, unnest(generate_series(x0, x0+w-1)) AS x FROM r), unnest(generate_series(y0, y0+h-1)) u(y)
)"""


def vector_rects(spark, d):
    n = lambda k, m: F.abs(F.floor(F.col("embedding")[k].cast("double") * 100)) % m
    at = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("frame_id"), F.col("vec_id").alias("mask_id"), n(0, 40).alias("x0"), n(1, 30).alias("y0"), n(2, 24).alias("w"), n(3, 18).alias("h"))
    return at.select("frame_id", "mask_id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


def vector_runs(spark, d):
    return runs.runs_of_rects(vector_rects(spark, d), WIDTH)


IOU_SQL = f"""WITH {RUN_SQL}, n AS (SELECT mask_id, count(*) AS n FROM px GROUP BY 1),
i AS (SELECT p.frame_id, p.mask_id AS a, q.mask_id AS b, count(*) AS inter FROM px p JOIN px q ON p.frame_id=q.frame_id AND p.x=q.x AND p.y=q.y AND p.mask_id<q.mask_id GROUP BY 1,2,3)
SELECT frame_id, a, b, inter, round(inter/(x.n+y.n-inter)::DOUBLE,6) AS iou FROM i JOIN n x ON x.mask_id=a JOIN n y ON y.mask_id=b"""


@q("q_run_iou", IOU_SQL)
def q_run_iou(spark, d):
    return runs.iou(vector_runs(spark, d)).withColumn("iou", r6("iou"))


ALGEBRA_SQL = f"""WITH {RUN_SQL}, f AS (SELECT frame_id, x, y, bool_or(mask_id % 2 = 0) AS a, bool_or(mask_id % 2 = 1) AS b FROM px GROUP BY 1,2,3)
SELECT frame_id, count(*) FILTER (a OR b) AS n_or, count(*) FILTER (a AND b) AS n_and, count(*) FILTER (a AND NOT b) AS n_minus, count(*) FILTER (a <> b) AS n_xor FROM f GROUP BY 1"""


@q("q_run_algebra", ALGEBRA_SQL)
def q_run_algebra(spark, d):
    """Pixels of a frame's even and odd masks, together and apart."""
    r, a, b = vector_runs(spark, d), F.col("in_a"), F.col("in_b")
    even, odd = r.where("mask_id % 2 = 0"), r.where("mask_id % 2 = 1")
    kinds = {"n_or": a | b, "n_and": a & b, "n_minus": a & ~b, "n_xor": a != b}
    d = runs.swept(even, odd, "frame_id").where(a | b).withColumn("n", F.col("stop") - F.col("start"))
    return d.groupBy("frame_id").agg(*(F.sum(F.when(k, F.col("n")).otherwise(F.lit(0))).alias(n) for n, k in kinds.items()))


RESIZE_SQL = f"""WITH {RUN_SQL}, t AS (SELECT x2, y2, x2*{WIDTH}//100 AS x, y2*{HEIGHT}//30 AS y FROM range(100) a(x2), range(30) b(y2))
SELECT frame_id, mask_id, count(*) AS area, min(y2*100+x2) AS first, max(y2*100+x2) AS last FROM px JOIN t USING (x, y) GROUP BY 1,2"""


@q("q_run_resize", RESIZE_SQL)
def q_run_resize(spark, d):
    r = runs.resized(vector_runs(spark, d), (WIDTH, HEIGHT), (100, 30))
    return r.groupBy("frame_id", "mask_id").agg(F.sum(F.col("stop") - F.col("start")).alias("area"), F.min("start").alias("first"), (F.max("stop") - 1).alias("last"))
