"""Segmentation: labelling, splitting and flooding masks. A field of view's mask is worked on in one task, others in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import regions as K
from ..schema import DDL
from .levels import Levels
from .masks import merge_masks, reduce_masks
from .pixel_filters import threshold_binarize
from .reduce import reduce
from .select import area_filter

MASK = DDL["mask_pixels"]


def _dense(f: pd.DataFrame, shape: tuple[int, int, int] | None = None, values: np.ndarray | float = True) -> tuple[np.ndarray, np.ndarray]:
    """Pixels as an array from their smallest place on (or of the given shape from 0), and that place."""
    at = f[["z", "y", "x"]].to_numpy(int)
    low = np.zeros(3, int) if shape else at.min(axis=0)
    out = np.zeros(shape or tuple(at.max(axis=0) - low + 1), bool if values is True else float)
    out[tuple((at - low).T)] = values
    return out, low


def _rows(labels: np.ndarray, low: np.ndarray, fov: str) -> pd.DataFrame:
    at = np.argwhere(labels)
    return pd.DataFrame({"fov": fov, "mask_id": labels[tuple(at.T)] - 1, "z": at[:, 0] + low[0], "y": at[:, 1] + low[1], "x": at[:, 2] + low[2]})


def structural_label(mask_pixels: DataFrame, connectivity: int = 1) -> DataFrame:
    """Connected components of each field of view's single mask, as masks numbered from 0."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, low = _dense(f)
        return _rows(K.label(a.astype(int), connectivity)[0], low, f["fov"].iloc[0])

    return _single(mask_pixels).groupBy("fov").applyInPandas(run, MASK)


def _single(mask_pixels: DataFrame) -> DataFrame:
    if mask_pixels.groupBy("fov").agg(F.countDistinct("mask_id").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("one mask per field of view is needed")
    return mask_pixels


def min_distance_label(mask_pixels: DataFrame, minimum_distance_xy: int = 1, minimum_distance_z: int = 1, exclude_border: bool = False) -> DataFrame:
    """The single mask split around peaks of the distance to the background. Outside the mask's extent all is background."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, low = _dense(f)
        wide = np.pad(a, [(0, 0) if a.shape[0] == 1 else (1, 1), (1, 1), (1, 1)])
        if a.shape[0] == 1:
            labels = K.min_distance_label(wide[0], minimum_distance_xy, minimum_distance_z, exclude_border)[None]
            return _rows(labels, low - [0, 1, 1], f["fov"].iloc[0])
        return _rows(K.min_distance_label(wide, minimum_distance_xy, minimum_distance_z, exclude_border), low - 1, f["fov"].iloc[0])

    return _single(mask_pixels).groupBy("fov").applyInPandas(run, MASK)


def map_masks(mask_pixels: DataFrame, func: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int, int]) -> DataFrame:
    """func of each whole mask (an array of the given shape) -> a mask of that shape."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, low = _dense(f, shape)
        out = np.asarray(func(a), bool)
        if out.shape != shape:
            raise ValueError(f"the function made {out.shape} of {shape}")
        return _rows(out.astype(int), low, f["fov"].iloc[0]).assign(mask_id=f["mask_id"].iloc[0])

    return mask_pixels.groupBy("fov", "mask_id").applyInPandas(run, MASK)


def watershed_segment(pixels: DataFrame, markers: DataFrame | None = None, mask: DataFrame | None = None, connectivity: int = 1) -> DataFrame:
    """Flood 1 - image (one round and channel) from marker masks inside mask; the regions as masks in order of their marker."""
    image = pixels.select("fov", "z", "y", "x", F.col("value").alias("value"))
    keys = ["fov", "z", "y", "x"]
    if markers is not None:
        image = image.join(markers.groupBy(*keys).agg((F.max("mask_id") + 1).alias("marker")).hint("merge"), keys, "left")
    else:
        image = image.withColumn("marker", F.lit(0))
    inside = F.lit(True) if mask is None else F.col("in_mask").isNotNull()
    if mask is not None:
        image = image.join(mask.select(*keys, F.lit(1).alias("in_mask")).distinct().hint("merge"), keys, "left")
    rows = image.select(*keys, "value", F.coalesce("marker", F.lit(0)).cast("int").alias("marker"), inside.alias("inside"))
    given = markers is not None

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, low = _dense(f, values=f["value"].to_numpy(float))
        m = _dense(f, values=f["marker"].to_numpy(float))[0].astype(int)
        i = _dense(f, values=f["inside"].to_numpy(float))[0].astype(bool)
        return _rows(K.watershed(1 - a, m if given else None, i, connectivity), low, f["fov"].iloc[0])

    return rows.groupBy("fov").applyInPandas(run, MASK)


def watershed_cells(primary: DataFrame, nuclei: DataFrame, nuclei_threshold: float, input_threshold: float, min_distance: int | None, size: tuple[int, int] = (10, 10_000)) -> DataFrame:
    """Cells: nuclei found in a nuclei stack, grown over the stain of the primary images.

    The stain is the mean over rounds of the largest value over channels and planes, scaled to 1.
    """
    stain = reduce(reduce(primary, ("c", "z"), "max"), ("r",), "mean", method=Levels.SCALE_BY_IMAGE)
    flat = reduce(nuclei, ("r", "c", "z"), "max", method=Levels.SCALE_BY_IMAGE)
    binary = threshold_binarize(flat, nuclei_threshold)
    labelled = structural_label(binary) if min_distance is None else min_distance_label(binary, min_distance, 1)
    markers = renumber(area_filter(labelled, *size))
    mask = reduce_masks(merge_masks([threshold_binarize(stain, input_threshold), markers]), "logical_or")
    return watershed_segment(stain, markers, mask, connectivity=2)


def renumber(mask_pixels: DataFrame) -> DataFrame:
    """mask_id anew from 0 in order, without gaps."""
    return merge_masks([mask_pixels])


def from_rois(rois: DataFrame, height: int, width: int) -> DataFrame:
    """Polygons (fov, mask_id, y and x as arrays of corners) as masks; corners and edges count as inside."""

    def run(frames):
        for f in frames:
            parts = [pd.DataFrame(columns=["fov", "mask_id", "z", "y", "x"])]
            for fov, i, y, x in f.itertuples(index=False):
                yx = np.argwhere(K.fill_polygon(np.asarray(y, float), np.asarray(x, float), (height, width)))
                parts.append(pd.DataFrame({"fov": fov, "mask_id": i, "z": 0, "y": yx[:, 0], "x": yx[:, 1]}))
            yield pd.concat(parts, ignore_index=True).astype({k: "int32" for k in ("mask_id", "z", "y", "x")})

    return rois.select("fov", "mask_id", "y", "x").mapInPandas(run, MASK)
