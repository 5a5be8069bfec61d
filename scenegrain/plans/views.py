"""Queries on views: points projected by the cells that frames see, and features streamed frame by frame."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenegrain.functions import scalar as s
from scenegrain.operators import segments as sg
from scenegrain.operators import views
from scenegrain.plans.registry import ORACLES, VIEW, frames, hits, points, q, r6, rects, visible
from scenegrain.sources.tables import shared_dir
from scenegrain.streaming.features import run_available, running_features


@q("q_project_in_view", VIEW + "SELECT frame_id, point_id, u, v, round(pz,6) AS pz FROM vis")
def q_project_in_view(spark, d):
    return views.project_in_view(points(spark, d), frames(spark), s.WIDTH, s.HEIGHT).withColumn("pz", r6("pz"))


@q("q_streamed_features", ORACLES["q_point_features"])
def q_streamed_features(spark, d):
    """The rows of q_point_features from a stream: each frame's points with the sum of the features of their masks."""
    m = rects(spark).select("frame_id", "mask_id", F.array(F.col("score"), F.col("score") * F.col("x0"), F.col("score") * F.col("y1")).alias("feat"))
    sums = hits(spark, d).join(F.broadcast(m), ["frame_id", "mask_id"]).groupBy("frame_id", "point_id").agg(sg.vector_sum("feat").alias("feat"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_id") * 60)
    rows = visible(spark, d).select("frame_id", "point_id").join(sums, ["frame_id", "point_id"], "left").withColumn("at", at)
    path = f"{shared_dir(spark)}/scenegrain/features-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    run_available(running_features(stream, ["point_id"], "feat", "at"), f"{path}/out", f"{path}/check")
    out = spark.read.schema("point_id long, feat array<double>, n_frames long, final boolean").parquet(f"{path}/out/*")
    last = out.groupBy("point_id").agg(F.max(F.struct("n_frames", "feat")).alias("last"))
    return last.select("point_id", F.posexplode("last.feat").alias("pos", "val")).select("point_id", F.col("pos").cast("long").alias("pos"), r6("val").alias("val"))
