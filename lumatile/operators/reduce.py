"""Map and reduce over image stacks: per value in SQL, per chunk in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.registry import mapper, reducer
from ..schema import AXES, PHYSICAL
from .levels import Levels, level


def map_values(pixels: DataFrame, name: str, *args, group_by: tuple[str, ...] = ("r", "c", "z"), method: Levels = Levels.CLIP) -> DataFrame:
    """A named function of each value, then levels."""
    out = pixels.withColumn("value", mapper(name, *args)(F.col("value")))
    return level(out, method, ("fov", *group_by))


def reduce(pixels: DataFrame, dims: tuple[str, ...], name: str = "max", *args, method: Levels = Levels.CLIP) -> DataFrame:
    """Aggregate the values over dims, then levels. Reduced axes have the one label 0; labels of all others are renumbered from 0.

    One shuffle: aggregation is partial before it. Scaling by chunk and by image are the same here.
    """
    rest = [a for a in AXES if a not in dims]
    out = pixels.groupBy("fov", *rest).agg(reducer(name, *args)(F.col("value")).alias("value"))
    for a in rest[: len([x for x in rest if x in ("r", "c", "z")])]:
        from .select import positions

        at = positions(out, a).select("fov", F.col("label").alias(a), F.col("position").cast("int").alias("__p"))
        out = out.join(at, ["fov", a], "left").withColumn(a, F.col("__p")).drop("__p")
    for a in dims:
        out = out.withColumn(a, F.lit(0))
    by_image = {Levels.SCALE_BY_CHUNK: Levels.SCALE_BY_IMAGE, Levels.SCALE_SATURATED_BY_CHUNK: Levels.SCALE_SATURATED_BY_IMAGE}
    return level(out.select("fov", *AXES, "value"), by_image.get(method, method))


def reduced_ticks(ticks: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Axis ticks after reduce(): those of a reduced axis become one, their mean."""
    own = F.col("axis").isin(*[PHYSICAL.get(d, d) for d in dims])
    one = ticks.where(own).groupBy("fov", "axis").agg(F.avg("phys").alias("phys")).select("fov", "axis", F.lit(0).alias("idx"), "phys")
    return ticks.where(~own).select("fov", "axis", "idx", "phys").unionByName(one)


def transform(pixels: DataFrame, func: Callable, group_by: tuple[str, ...], schema: str | StructType) -> DataFrame:
    """func(pandas frame of one chunk) -> frame of any rows, per field of view and label of group_by: the general escape hatch."""
    return pixels.groupBy("fov", *group_by).applyInPandas(func, schema)


def apply(pixels: DataFrame, func: Callable, group_by: tuple[str, ...] = ("r", "c", "z"), method: Levels = Levels.CLIP) -> DataFrame:
    """func(numpy chunk with axes in order r, c, z, y, x without those of group_by) -> chunk of the same shape, then levels."""
    import pandas as pd

    inner = [a for a in AXES if a not in group_by]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(inner, kind="stable")
        chunk = frame["value"].to_numpy().reshape([frame[a].nunique() for a in inner])
        out = func(chunk)
        if out.shape != chunk.shape:
            raise ValueError(f"the function made {out.shape} of {chunk.shape}")
        return frame.assign(value=out.ravel().astype(float))

    return level(pixels.groupBy("fov", *group_by).applyInPandas(run, pixels.schema), method, ("fov", *group_by))
