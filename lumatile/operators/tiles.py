"""Tiles and pixels, and running image kernels over tiles in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DDL
from .levels import Levels

TILE = DDL["tiles"]


def to_tiles(pixels: DataFrame, kind: str = "float") -> DataFrame:
    """Dense long pixels as one row per plane, of float or double values. A plane's pixels meet in one task, as they do in its file."""
    g = pixels.groupBy("fov", "r", "c", "z").agg(
        (F.max("y") - F.min("y") + 1).cast("int").alias("height"), (F.max("x") - F.min("x") + 1).cast("int").alias("width"),
        F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "value"))), lambda s: s["value"].cast(kind)).alias("pixels"))
    return g


def to_pixels(tiles: DataFrame) -> DataFrame:
    e = tiles.select("fov", "r", "c", "z", "width", F.posexplode("pixels").alias("i", "value"))
    return e.select("fov", "r", "c", "z", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), F.col("value").cast("double").alias("value"))


def levelled(a: np.ndarray, method: Levels) -> np.ndarray:
    """Levels of one chunk; the methods by image only cut negative values here."""
    a = np.maximum(a, 0)
    if method is Levels.CLIP:
        return np.minimum(a, 1)
    top = a.max(initial=0)
    if method is Levels.SCALE_BY_CHUNK and top > 0 or method is Levels.SCALE_SATURATED_BY_CHUNK and top > 1:
        return a / top
    return a


def scale_by_image(tiles: DataFrame, method: Levels) -> DataFrame:
    """The rest of the levels by image: divide by the field of view's largest value."""
    if method not in (Levels.SCALE_BY_IMAGE, Levels.SCALE_SATURATED_BY_IMAGE):
        return tiles
    top = tiles.groupBy("fov").agg(F.max(F.array_max("pixels")).cast("double").alias("__top"))
    kind = dict(tiles.dtypes)["pixels"][6:-1]
    divide = F.col("__top") > (1 if method is Levels.SCALE_SATURATED_BY_IMAGE else 0)
    scaled = F.transform("pixels", lambda v: (v / F.col("__top")).cast(kind))
    return tiles.join(top, "fov").withColumn("pixels", F.when(divide, scaled).otherwise(F.col("pixels"))).drop("__top")


def apply_kernel(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    """kernel(plane or volume) -> the same shape, then levels.

    Planes are worked on where they are, without a shuffle; a volume's planes are brought together.
    """

    tiles = tiles.select("fov", "r", "c", "z", "height", "width", "pixels")
    schema = tiles.schema
    kind = np.float64 if dict(tiles.dtypes)["pixels"] == "array<double>" else np.float32

    def plane(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [levelled(np.asarray(kernel(np.asarray(p, float).reshape(h, w))), method).astype(kind).ravel() for p, h, w in zip(f["pixels"], f["height"], f["width"], strict=True)]
            yield f.assign(pixels=out)

    def volume(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("z")
        h, w = int(f["height"].iloc[0]), int(f["width"].iloc[0])
        out = levelled(np.asarray(kernel(np.stack([np.asarray(p, float).reshape(h, w) for p in f["pixels"]]))), method)
        return f.assign(pixels=[p.astype(kind).ravel() for p in out])

    done = tiles.groupBy("fov", "r", "c").applyInPandas(volume, schema) if is_volume else tiles.mapInPandas(plane, schema)
    return scale_by_image(done, method)


def stack_of(f: pd.DataFrame) -> np.ndarray:
    """Tiles of one round and channel as a volume, in order of z."""
    f = f.sort_values("z")
    return np.stack([np.asarray(p, float).reshape(h, w) for p, h, w in zip(f["pixels"], f["height"], f["width"], strict=True)])
