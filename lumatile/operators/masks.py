"""Masks and label images as sets of pixels: (fov, mask_id, z, y, x) and (fov, z, y, x, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ("fov", "z", "y", "x")


def bounding_boxes(mask_pixels: DataFrame) -> DataFrame:
    """Of each mask its area and bounds, the upper ones included, and its name: mask_id padded to the width of the largest id."""
    widest = mask_pixels.groupBy("fov").agg(F.length(F.max("mask_id").cast("string")).alias("__w"))
    boxes = mask_pixels.groupBy("fov", "mask_id").agg(F.count("*").alias("area"), *(f(a).alias(f"{a}_{n}") for a in ("z", "y", "x") for n, f in (("min", F.min), ("max", F.max))))
    return boxes.join(widest, "fov").withColumn("name", F.expr("lpad(CAST(mask_id AS STRING), __w, '0')")).drop("__w")


def regionprops(mask_pixels: DataFrame) -> DataFrame:
    """bounding_boxes with centroids and the diameter of a disc (one plane) or ball of the same area."""
    c = mask_pixels.groupBy("fov", "mask_id").agg(*(F.avg(a).alias(f"centroid_{a}") for a in ("z", "y", "x")))
    boxes = bounding_boxes(mask_pixels).join(c, ["fov", "mask_id"])
    flat = F.col("z_min") == F.col("z_max")
    return boxes.withColumn("equivalent_diameter", F.when(flat, F.sqrt(F.lit(4.0) * F.col("area") / F.pi())).otherwise(F.cbrt(F.lit(6.0) * F.col("area") / F.pi())))


def reduce_masks(mask_pixels: DataFrame, func: str = "logical_or") -> DataFrame:
    """All masks of a field of view folded into mask 0: logical_or, logical_and or logical_xor."""
    n = mask_pixels.groupBy(*PIXEL).agg(F.count("*").alias("__n"))
    if func == "logical_or":
        out = n
    elif func == "logical_xor":
        out = n.where("__n % 2 = 1")
    elif func == "logical_and":
        out = n.join(mask_pixels.groupBy("fov").agg(F.countDistinct("mask_id").alias("__all")).hint("merge"), "fov").where("__n = __all")
    else:
        raise ValueError(f"{func!r} is none of logical_or, logical_and, logical_xor")
    return out.select("fov", F.lit(0).alias("mask_id"), "z", "y", "x")


def merge_masks(collections: list[DataFrame], frames: list[DataFrame] | None = None) -> DataFrame:
    """Masks of several collections, renumbered in order. frames: axis ticks of each, which must be equal."""
    if frames:
        first = frames[0].select("fov", "axis", "idx", "phys")
        for f in frames[1:]:
            f = f.select("fov", "axis", "idx", "phys")
            if first.exceptAll(f).unionByName(f.exceptAll(first)).limit(1).count():
                raise ValueError("the collections' ticks differ")
    tagged = [c.select(F.lit(i).alias("__from"), "fov", "mask_id", "z", "y", "x") for i, c in enumerate(collections)]
    out = tagged[0]
    for c in tagged[1:]:
        out = out.unionByName(c)
    ids = out.select("__from", "fov", "mask_id").distinct()
    number = (F.row_number().over(Window.partitionBy("fov").orderBy("__from", "mask_id")) - 1).cast("int")  # a row per mask
    return out.join(ids.withColumn("__id", number).hint("merge"), ["__from", "fov", "mask_id"]).select("fov", F.col("__id").alias("mask_id"), "z", "y", "x")


def to_label_image(mask_pixels: DataFrame) -> DataFrame:
    """label = mask_id + 1; where masks overlap the last one shows."""
    return mask_pixels.groupBy(*PIXEL).agg((F.max("mask_id") + 1).cast("int").alias("label"))


def from_label_image(labels: DataFrame) -> DataFrame:
    """Masks numbered from 0 in order of their labels; label 0 is background."""
    found = labels.where("label > 0")
    ids = found.select("fov", "label").distinct().withColumn("mask_id", (F.row_number().over(Window.partitionBy("fov").orderBy("label")) - 1).cast("int"))
    return found.join(ids, ["fov", "label"]).select("fov", "mask_id", "z", "y", "x")


def uncropped(mask_pixels: DataFrame, frame: DataFrame) -> DataFrame:
    """Every pixel of the frame (fov, z, y, x) with each mask of its field of view, and whether it is in it."""
    ids = mask_pixels.select("fov", "mask_id").distinct()
    return frame.join(ids, "fov").join(mask_pixels.withColumn("inside", F.lit(True)), ["fov", "mask_id", "z", "y", "x"], "left").na.fill(False, ["inside"])
