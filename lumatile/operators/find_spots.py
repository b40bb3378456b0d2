"""Spot finders over tiles. Without a reference image spots are found in every round and channel; with one they are found there once and measured everywhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import blobs as K
from ..schema import DDL
from .reduce import reduce
from .spots import measure_across_imagestack
from .tiles import stack_of, to_pixels, to_tiles

_EXTRA = ", total_intensity DOUBLE, eccentricity DOUBLE, raw_mass DOUBLE"


def _find(tiles: DataFrame, finder: Callable[[np.ndarray], list[tuple]], is_volume: bool, more: str = "") -> DataFrame:
    """finder(volume or plane) -> (z, y, x, radius, intensity, ...), one task per round and channel; ids count from 0 in each."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        stack, zs = stack_of(f), np.sort(f["z"].to_numpy())
        if is_volume:
            rows = [(float(zs[int(s[0])]) if float(s[0]).is_integer() else float(s[0]) + float(zs[0]), *s[1:]) for s in finder(stack)]
        else:
            rows = [(float(z), *s[1:]) for z, plane in zip(zs, stack, strict=True) for s in finder(plane)]
        names = ["z", "y", "x", "radius", "intensity", *(x.split()[0] for x in more.split(", ") if x)]
        out = pd.DataFrame(rows, columns=names).astype(float)
        out.insert(0, "spot_id", np.arange(len(out)))
        for k in ("c", "r", "fov"):
            out.insert(0, k, f[k].iloc[0])
        return out

    return tiles.groupBy("fov", "r", "c").applyInPandas(run, DDL["spots"].replace("spot_id BIGINT,", "spot_id BIGINT,") + more)


def _with_reference(found: Callable[[DataFrame], DataFrame], tiles: DataFrame, reference: DataFrame | None, measurement: str, gyration: bool = False) -> DataFrame:
    if reference is None:
        return found(tiles)
    spots = found(reference)
    ints = spots.withColumns({a: F.floor(a).cast("int") for a in ("z", "y", "x")}) if gyration else spots.withColumns({a: F.col(a).cast("int") for a in ("z", "y", "x")})
    return measure_across_imagestack(ints, to_pixels(tiles), measurement, gyration).select("fov", "r", "c", "spot_id", *(F.col(a).cast("double").alias(a) for a in ("z", "y", "x")), "radius", "intensity")


def projection(tiles: DataFrame, func: str = "max") -> DataFrame:
    """A reference image: all rounds and channels reduced to one, as tiles."""
    return to_tiles(reduce(to_pixels(tiles), ("r", "c"), func))


def blob_detector(tiles: DataFrame, min_sigma: float, max_sigma: float, num_sigma: int, threshold: float, overlap: float = 0.5, measurement_type: str = "max", is_volume: bool = True, detector_method: str = "blob_log", exclude_border: bool | int = False, reference: DataFrame | None = None) -> DataFrame:
    """Blobs by Laplacian of Gaussian, difference of Gaussians or determinant of Hessian."""
    if detector_method not in K.METHODS:
        raise ValueError(f"detector method {detector_method!r} is none of {sorted(K.METHODS)}")
    if detector_method == "blob_doh" and is_volume and reference is None:
        raise ValueError("blob_doh takes planes only")
    options = {"min_sigma": min_sigma, "max_sigma": max_sigma, "threshold": threshold, "overlap": overlap, "exclude_border": exclude_border}
    if detector_method != "blob_dog":
        options["num_sigma"] = num_sigma
    finder = lambda a: K.spots_by_blobs(a, detector_method, **options)
    return _with_reference(lambda t: _find(t, finder, is_volume or reference is not None), tiles, reference, measurement_type)


def local_max_peak_finder(tiles: DataFrame, min_distance: int, stringency: int, min_obj_area: int, max_obj_area: int, measurement_type: str = "max", min_num_spots_detected: int = 3, is_volume: bool = True, reference: DataFrame | None = None) -> DataFrame:
    """Local maxima above a threshold chosen from the number of spots over thresholds, in components of allowed area."""
    finder = lambda a: K.spots_by_local_max(a, min_distance, stringency, min_obj_area, max_obj_area, min_num_spots_detected)
    return _with_reference(lambda t: _find(t, finder, is_volume or reference is not None), tiles, reference, measurement_type)


def trackpy_local_max_peak_finder(tiles: DataFrame, spot_diameter: int | tuple[int, ...], min_mass: float, max_size: float, separation: float, percentile: float = 0, noise_size: float = 1, preprocess: bool = False, max_iterations: int = 10, measurement_type: str = "max", is_volume: bool = True, reference: DataFrame | None = None) -> DataFrame:
    """Crocker-Grier spots with total intensity, radius of gyration, eccentricity, peak intensity and raw mass; volumes only."""
    if not is_volume:
        raise ValueError("planes are not supported")

    def finder(a: np.ndarray) -> list[tuple]:
        flat = a[0] if a.shape[0] == 1 else a
        out = []
        for s in K.locate(flat, spot_diameter, min_mass, max_size, separation, percentile, noise_size, preprocess, max_iterations):
            at = (0.0, *s["at"]) if flat.ndim == 2 else tuple(s["at"])
            out.append((*at, s["size"], s["signal"], s["mass"], s["ecc"], s["raw_mass"]))
        return out

    return _with_reference(lambda t: _find(t, finder, True, _EXTRA), tiles, reference, measurement_type, gyration=True)
