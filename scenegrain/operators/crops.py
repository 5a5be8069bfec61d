"""Image crops around masks and their features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scenegrain.functions import models
from scenegrain.functions.scalar import l2_normalize
from scenegrain.operators.geometry import mask_boxes


def cut(data: bytes, width: int, channels: int, x0: int, y0: int, x1: int, y1: int) -> bytes:
    """The bytes of a box of row-major pixels."""
    return np.frombuffer(data, np.uint8).reshape(-1, width, channels)[y0:y1, x0:x1].tobytes()


def cropped(*cols: str) -> Column:
    """cut() of columns."""

    @pandas_udf("binary")
    def run(data: pd.Series, width: pd.Series, channels: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([cut(*r) for r in zip(data, width, channels, x0, y0, x1, y1)])

    return run(*cols)


def crop_features(images: DataFrame, pixels: DataFrame, least: int = 32, model: str = "embed_image") -> DataFrame:
    """frame_id, mask_id, area, feat: the box around each mask of at least `least` pixels, cut from its frame and embedded.

    Images are rows of frame_id, width, channels and data (row-major bytes); masks are pixels (frame_id, mask_id, x, y).
    Masks of frames without an image are left out. An image meets its boxes by frame_id, so it moves once.
    """
    box = mask_boxes(pixels, least)
    d = box.join(images.select("frame_id", "width", "channels", "data"), "frame_id")
    crop = cropped("data", "width", "channels", "x0", "y0", "x1", "y1")
    f = d.select("frame_id", "mask_id", "area", models.apply(model, crop).alias("feat"))
    return f.withColumn("feat", l2_normalize(F.col("feat")))
