"""Joins in space. Catalyst has no range or nearest-neighbour join that avoids comparing all pairs, so rows are put in grid cells and joined on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(size))).cast("long")


def radius_join(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = ("fov",), axes: tuple[str, ...] = ("z", "y", "x"), strict: bool = False, prefix: str = "o_") -> DataFrame:
    """Pairs of left and right rows within radius (below it if strict), equal in `on`.

    Right columns get the prefix; dist is the distance. Left rows are copied into the 3 cells per
    axis that can hold partners, so the join is an equi-join that Spark can shuffle, split and
    spill. A radius of 0 joins equal places.
    """
    size = float(radius) or 1.0
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    for a in axes:
        left = left.withColumn("__d", F.explode(near)).withColumn(f"__{a}", _cell(a, size) + F.col("__d")).drop("__d")
    other = right.select(*(F.col(c).alias(prefix + c) for c in right.columns), *(_cell(a, size).alias(f"__{a}") for a in axes), *(F.col(c).alias(f"__on_{c}") for c in on))
    cond = [left[f"__{a}"] == other[f"__{a}"] for a in axes] + [left[c] == other[f"__on_{c}"] for c in on]
    both = left.join(other, cond).drop(*(f"__on_{c}" for c in on), *(other[f"__{a}"] for a in axes)).drop(*(f"__{a}" for a in axes))
    square = sum((F.pow(F.col(a) - F.col(prefix + a), F.lit(2.0)) for a in axes), F.lit(0.0))
    dist = F.sqrt(square)
    return both.withColumn("dist", dist).where(F.col("dist") < radius if strict else F.col("dist") <= radius)


def nearest(left: DataFrame, right: DataFrame, radius: float, key: tuple[str, ...], per: tuple[str, ...], tie: str, on: tuple[str, ...] = ("fov",), axes: tuple[str, ...] = ("z", "y", "x"), prefix: str = "o_") -> DataFrame:
    """For each left row (key) and each value of the right columns `per`, the nearest right row below radius; ties go to the smallest `tie`.

    Pairs carry only keys, distance and tie through the aggregate, which has partial results before
    its shuffle; the other columns of the nearest rows, one per result, are joined afterwards, so
    `tie` must name a right row within `on`.
    """
    slim = right.select(*on, *dict.fromkeys((*per, tie, *axes)))
    pairs = radius_join(left.select(*on, *key, *axes), slim, radius, on, axes, strict=True, prefix=prefix)
    order = F.struct(F.round("dist", 9).alias("d"), F.col(prefix + tie).alias("t"))
    best = pairs.groupBy(*on, *key, *(F.col(prefix + p) for p in per)).agg(F.min(order).alias("n")).select(*on, *key, F.col("n.d").alias("dist"), F.col("n.t").alias(prefix + tie))
    rest = right.select(*(F.col(c).alias(f"__{c}") for c in on), *(F.col(c).alias(prefix + c) for c in right.columns if c not in on))
    return best.join(rest.withColumnRenamed(prefix + tie, "__tie"), [*(best[c] == F.col(f"__{c}") for c in on), best[prefix + tie] == F.col("__tie")]).drop("__tie", *(f"__{c}" for c in on))


def box_join(boxes: DataFrame, points: DataFrame, axes: tuple[str, ...] = ("z", "y", "x"), on: tuple[str, ...] = ("fov",)) -> DataFrame:
    """Points inside boxes [axis_min, axis_max): boxes are spread over the whole positions they cover, so points join on equal coordinates.

    For boxes of pixels whose size is a spot's, not an image's. Neither side is broadcast, as
    estimates of its size don't count what boxes are spread to.
    """
    for a in axes:
        boxes = boxes.where(F.col(f"{a}_max") > F.col(f"{a}_min")).withColumn(a, F.explode(F.sequence(F.col(f"{a}_min"), F.col(f"{a}_max") - 1)))
    return boxes.join(points.hint("merge"), [*on, *axes])
