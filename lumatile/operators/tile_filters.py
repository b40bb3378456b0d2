"""Filters with image kernels, over tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..kernels import filters as K
from .levels import Levels
from .tiles import apply_kernel

Sigma = float | tuple[float, ...]


def bandpass(tiles: DataFrame, lshort: float, llong: int, threshold: float = 0, truncate: float = 4, is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    if threshold is None:
        raise ValueError("threshold must be a number")
    return apply_kernel(tiles, lambda a: K.bandpass(a, lshort, llong, threshold, truncate), is_volume, method)


def gaussian_low_pass(tiles: DataFrame, sigma: Sigma, is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    K.per_axis(sigma, 3 if is_volume else 2)
    return apply_kernel(tiles, lambda a: K.gaussian(a, sigma), is_volume, method)


def gaussian_high_pass(tiles: DataFrame, sigma: Sigma, is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    """The image less its smoothed copy, which is first limited to [0, 1]."""
    K.per_axis(sigma, 3 if is_volume else 2)
    return apply_kernel(tiles, lambda a: a - K.gaussian(a, sigma).clip(0, 1), is_volume, method)


def laplace(tiles: DataFrame, sigma: Sigma, mode: str = "reflect", is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    K.per_axis(sigma, 3 if is_volume else 2)
    return apply_kernel(tiles, lambda a: -K.gaussian_laplace(a, sigma, mode), is_volume, method)


def mean_high_pass(tiles: DataFrame, size: int | tuple[int, ...], is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    K.per_axis(size, 3 if is_volume else 2)
    return apply_kernel(tiles, lambda a: a - K.uniform(a, size), is_volume, method)


def deconvolve_psf(tiles: DataFrame, num_iter: int, sigma: float, is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    return apply_kernel(tiles, lambda a: K.richardson_lucy(a, sigma, num_iter), is_volume, method)


def white_tophat(tiles: DataFrame, masking_radius: int, is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    return apply_kernel(tiles, lambda a: K.white_tophat(a, masking_radius), is_volume, method)


#: Hook for probabilities that an external classifier wrote: the caller gives a function of (fov, r, c, z) to a plane.
def import_probabilities(tiles: DataFrame, read) -> DataFrame:
    """tiles with their pixels replaced by read(fov, r, c, z), a plane of the same size."""
    import numpy as np

    from .tiles import TILE

    def run(frames):
        for f in frames:
            yield f.assign(pixels=[np.asarray(read(*k), np.float32).ravel() for k in zip(f["fov"], f["r"], f["c"], f["z"], strict=True)])

    return tiles.select("fov", "r", "c", "z", "height", "width", "pixels").mapInPandas(run, TILE)
