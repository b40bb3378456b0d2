"""Keeping values in [0, 1]: clip, or scale by the largest value of a chunk or of the whole image."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Levels(Enum):
    CLIP = "clip"
    SCALE_BY_IMAGE = "scale_by_image"
    SCALE_BY_CHUNK = "scale_by_chunk"
    SCALE_SATURATED_BY_IMAGE = "scale_saturated_by_image"
    SCALE_SATURATED_BY_CHUNK = "scale_saturated_by_chunk"


def level(pixels: DataFrame, method: Levels = Levels.CLIP, chunk: tuple[str, ...] = ("fov", "r", "c", "z"), value: str = "value") -> DataFrame:
    """Negative values become 0; then values above 1 become 1, or all are divided by the largest one.

    The largest is that of the row's chunk, or of its field of view for the methods by image. The
    saturated methods divide only if it exceeds 1. An image of zeros stays one. The maximum is
    aggregated before it is joined back, so that no chunk is gathered in one task; a left join can't
    broadcast the pixels.
    """
    v = F.greatest(F.col(value), F.lit(0.0))
    if method is Levels.CLIP:
        return pixels.withColumn(value, F.least(v, F.lit(1.0)))
    keys = ["fov"] if method in (Levels.SCALE_BY_IMAGE, Levels.SCALE_SATURATED_BY_IMAGE) else list(chunk)
    top = pixels.groupBy(*keys).agg(F.max(v).alias("__top"))
    divide = F.col("__top") > (1 if method.name.startswith("SCALE_SATURATED") else 0)
    return pixels.join(top, keys, "left").withColumn(value, F.when(divide, v / F.col("__top")).otherwise(v)).drop("__top").select(*pixels.columns)


def preserve_float_range(pixels: DataFrame, rescale: bool = False, rescale_saturated: bool = False, value: str = "value") -> DataFrame:
    """level() over each whole field of view; at most one of the flags may be set."""
    if rescale and rescale_saturated:
        raise ValueError("rescale and rescale_saturated exclude each other")
    method = Levels.SCALE_BY_IMAGE if rescale else Levels.SCALE_SATURATED_BY_IMAGE if rescale_saturated else Levels.CLIP
    return level(pixels, method, value=value)


def window_level(pixels: DataFrame, chunk: tuple[str, ...], value: str = "value") -> DataFrame:
    """Scale by chunk in a window; for chunks known to fit a task, saves the second read of the input."""
    v = F.greatest(F.col(value), F.lit(0.0))
    top = F.max(v).over(Window.partitionBy(*chunk))
    return pixels.withColumn(value, F.when(top > 0, v / top).otherwise(v))
