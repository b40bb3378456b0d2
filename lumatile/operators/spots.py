"""Spot tables: measuring spots in images, combining and counting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import ALIASES, reducer
from ..schema import SPOT_FIELDS, require
from .spatial import box_join


def _boxes(spots: DataFrame, radius_is_gyration: bool) -> DataFrame:
    """Bounds [v - (radius - 1), v + radius) per axis, from 0 on; a radius of gyration counts as its ceiling plus 1."""
    rad = (F.ceil("radius") + 1 if radius_is_gyration else F.col("radius")).cast("int")
    out = require(spots, SPOT_FIELDS, "spot table")
    for a in ("z", "y", "x"):
        v = F.col(a).cast("int")
        out = out.withColumns({f"{a}_min": F.greatest(v - (rad - 1), F.lit(0)), f"{a}_max": v + rad})
    return out


def _measured(measurement: str) -> Column:
    """The reducer over value. Means don't hang on the order of rows: a value's multiple of 2^-30 and its rest are summed apart, the former exactly up to sums of 2^23."""
    v = F.col("value").cast("double")
    if ALIASES.get(measurement, measurement) != "mean":
        return reducer(measurement)(F.col("value"))
    high = F.rint(v * 2.0**30) / 2.0**30
    return F.try_divide(F.sum(high) + F.sum(F.when(high == v, 0.0).otherwise(v - high)), F.count(v))


def measure_at_spots(spots: DataFrame, pixels: DataFrame, measurement: str = "max", radius_is_gyration: bool = False) -> DataFrame:
    """spots with intensity, measured over their box in an image of one round and channel; NULL if the box lies outside.

    Boxes join pixels on equal places and are aggregated by spot: no image is gathered.
    """
    boxes = _boxes(spots, radius_is_gyration)
    hits = box_join(boxes.select("fov", "spot_id", *(f"{a}_{m}" for a in ("z", "y", "x") for m in ("min", "max"))), pixels.select("fov", "z", "y", "x", "value"))
    found = hits.groupBy("fov", "spot_id").agg(_measured(measurement).alias("intensity"))
    return boxes.drop("intensity").join(found.hint("merge"), ["fov", "spot_id"], "left")


def measure_across_imagestack(spots: DataFrame, pixels: DataFrame, measurement: str = "max", radius_is_gyration: bool = False) -> DataFrame:
    """Reference spots measured in every round and channel: fov, spot_id, place, r, c, intensity."""
    boxes = _boxes(spots.drop("r", "c", "intensity"), radius_is_gyration)
    hits = box_join(boxes.select("fov", "spot_id", *(f"{a}_{m}" for a in ("z", "y", "x") for m in ("min", "max"))), pixels)
    found = hits.groupBy("fov", "spot_id", "r", "c").agg(_measured(measurement).alias("intensity"))
    return boxes.join(found.hint("merge"), ["fov", "spot_id"])


def combine_spots(tables: list[DataFrame]) -> DataFrame:
    """Spot tables below each other; columns that one lacks are NULL."""
    from .assign import concatenate

    return concatenate([require(t, SPOT_FIELDS, "spot table") for t in tables])


def renumber(spots: DataFrame, by: tuple[str, ...] = ("fov", "r", "c")) -> DataFrame:
    """spot_id anew from 0 in each round and channel, in order of place."""
    from pyspark.sql import Window

    return spots.withColumn("spot_id", F.row_number().over(Window.partitionBy(*by).orderBy("z", "y", "x", "spot_id")) - 1)


def count_total_spots(spots: DataFrame) -> DataFrame:
    return spots.agg(F.count("spot_id").alias("n"))


def labels(spots: DataFrame) -> DataFrame:
    """Distinct rounds and channels, sorted, by field of view."""
    return spots.groupBy("fov").agg(F.sort_array(F.collect_set("r")).alias("round_labels"), F.sort_array(F.collect_set("c")).alias("ch_labels"))
