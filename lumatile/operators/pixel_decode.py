"""Pixel decoding: every voxel's trace is decoded, then equal neighbours become spots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.regions import label
from .decode import decode_metric
from .graph import components
from .traces import pixel_features

PLACE = ("fov", "z", "y", "x")


def targets_map(decoded: DataFrame) -> DataFrame:
    """(target, code): targets in order of name from 1 on; no target is 0."""
    names = decoded.where("target IS NOT NULL").select("target").distinct()
    return names.withColumn("code", F.row_number().over(Window.orderBy("target")).cast("int"))  # a row per target


def decoded_image(decoded: DataFrame, codes: DataFrame, mask_failing: bool = True) -> DataFrame:
    """(fov, z, y, x, code): 0 where a pixel has no target or, if asked for, fails its thresholds."""
    ok = F.col("passes_thresholds") if mask_failing else F.lit(True)
    named = decoded.join(codes, "target", "left")
    return named.select(*PLACE, F.when(ok, F.coalesce("code", F.lit(0))).otherwise(0).cast("int").alias("code"))


def label_components(image: DataFrame, connectivity: int = 2) -> DataFrame:
    """image with label: connected pixels of one code in a field of view, numbered from 1 in order of their first pixel; background is left out."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        at = f[["z", "y", "x"]].to_numpy(int)
        low = at.min(axis=0)
        a = np.zeros(tuple(at.max(axis=0) - low + 1), int)
        a[tuple((at - low).T)] = f["code"]
        return f.assign(label=label(a, connectivity)[0][tuple((at - low).T)].astype("int32"))

    return image.where("code > 0").groupBy("fov").applyInPandas(run, "fov STRING, z INT, y INT, x INT, code INT, label INT")


def label_components_sql(image: DataFrame, connectivity: int = 2) -> DataFrame:
    """label_components for fields of view too large for one task: neighbours of one code are edges of a graph whose components are found."""
    steps = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 < abs(dz) + abs(dy) + abs(dx) <= connectivity and (dz, dy, dx) < (0, 0, 0)]
    now = image.where("code > 0").select(*PLACE, "code")
    offsets = F.array(*(F.struct(*(F.lit(v).alias(a) for v, a in zip(s, ("dz", "dy", "dx"), strict=True))) for s in steps))
    at = now.select(*PLACE, "code", F.explode(offsets).alias("d")).select("fov", *((F.col(a) + F.col(f"d.d{a}")).alias(a) for a in ("z", "y", "x")), "code", F.struct(*PLACE).alias("u"))
    edges = at.join(now, [*PLACE, "code"]).select("u", F.struct(*PLACE).alias("v"))
    roots = components(edges).select("node.*", F.col("root").alias("n"))
    rooted = now.join(roots, list(PLACE), "left").withColumn("n", F.coalesce("n", F.struct(*PLACE)))
    first = rooted.select("fov", "n").distinct().withColumn("label", F.row_number().over(Window.partitionBy("fov").orderBy("n")).cast("int"))
    return rooted.join(first, ["fov", "n"]).select(*PLACE, "code", "label")


def mean_pixel_traces(decoded: DataFrame, labels: DataFrame, ordered: bool = True) -> DataFrame:
    """(fov, label, trace, distance): means over each component's pixels, cell by cell.

    ordered: sums go by z, y, x, so that the same pixels give the same digits in every run; a
    component's pixels meet in one task. Otherwise sums are partly aggregated before the shuffle.
    """
    both = labels.select(*PLACE, "label").join(decoded.hint("merge"), list(PLACE))
    if ordered:
        held = both.where("size(trace) > 0").groupBy("fov", "label").agg(F.array_sort(F.collect_list(F.struct("z", "y", "x", "trace", "distance"))).alias("p"))
        known = lambda a: F.filter(a, lambda v: v.isNotNull())
        mean = lambda a: F.try_divide(F.aggregate(known(a), F.lit(0.0), lambda s, v: s + v), F.size(known(a)))
        cell = lambda i: mean(F.transform("p", lambda e: F.get(e["trace"], i)))
        last = F.array_max(F.transform("p", lambda e: F.size(e["trace"]))) - 1
        return held.select("fov", "label", F.transform(F.sequence(F.lit(0), last), cell).alias("trace"), mean(F.col("p")["distance"]).alias("distance"))
    cells = both.select("fov", "label", "distance", F.posexplode("trace").alias("i", "v"))
    means = cells.groupBy("fov", "label", "i").agg(F.avg("v").alias("v"), F.avg("distance").alias("distance"))
    return means.groupBy("fov", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("trace"), F.first("distance").alias("distance"))


def component_attributes(labels: DataFrame, image: DataFrame, codes: DataFrame, min_area: int, max_area: int) -> DataFrame:
    """A row per component: place (centroid, cut to whole pixels), bounds, area, radius of the disk or ball of its area, target, and whether min_area <= area < max_area.

    target: the most frequent code among all non-zero pixels of the bounding box, the smallest of
    equally frequent ones.
    """
    box = labels.groupBy("fov", "label").agg(F.count("*").alias("area"), *(f.alias(f"{a}{n}") for a in ("z", "y", "x") for n, f in (("", F.floor(F.avg(a)).cast("int")), ("_min", F.min(a)), ("_max", F.max(a)))))
    pix = image.where("code > 0").select("fov", F.col("z").alias("pz"), F.col("y").alias("py"), F.col("x").alias("px"), "code")
    # A box covers as many rows as it is high; its pixels join on the row.
    rows = box.select("fov", "label", "z_min", "z_max", "x_min", "x_max", F.explode(F.sequence("y_min", "y_max")).alias("py"))
    hits = rows.join(pix.hint("merge"), ["fov", "py"]).where("pz BETWEEN z_min AND z_max AND px BETWEEN x_min AND x_max").groupBy("fov", "label", "code").agg(F.count("*").alias("n"))
    mode = hits.groupBy("fov", "label").agg(F.min_by("code", F.struct(-F.col("n"), "code")).alias("code"))
    flat = F.col("z_min") == F.col("z_max")
    diameter = F.when(flat, F.sqrt(4 * F.col("area") / F.pi())).otherwise(F.cbrt(6 * F.col("area") / F.pi()))
    out = box.join(mode.hint("merge"), ["fov", "label"]).join(F.broadcast(codes), "code")  # a row per target
    return out.withColumns({"radius": diameter / 2, "passes_thresholds": (F.col("area") >= min_area) & (F.col("area") < max_area)})


def combine_adjacent_features(decoded: DataFrame, min_area: int, max_area: int, connectivity: int = 2, mask_filtered_features: bool = True, distributed: bool = False) -> DataFrame:
    """Decoded pixel features to decoded spots: fov, feature_id (from 0 in order of label), place, radius, area, trace, target, distance, passes_thresholds. No components: no rows."""
    codes = targets_map(decoded)
    image = decoded_image(decoded, codes, mask_filtered_features)
    labels = (label_components_sql if distributed else label_components)(image, connectivity)
    spots = component_attributes(labels, image, codes, min_area, max_area).join(mean_pixel_traces(decoded, labels, not distributed).hint("merge"), ["fov", "label"])
    return spots.select("fov", (F.col("label") - 1).cast("long").alias("feature_id"), "z", "y", "x", "radius", "area", "trace", "target", "distance", "passes_thresholds")


def pixel_spot_decoder(pixels: DataFrame, codes: DataFrame, size: int, metric: str, distance_threshold: float, magnitude_threshold: float, min_area: int, max_area: int, norm_order: float = 2) -> DataFrame:
    """An image stack to decoded spots: voxel traces, nearest code, components."""
    decoded = decode_metric(pixel_features(pixels), codes, size, distance_threshold, magnitude_threshold, norm_order, metric)
    return combine_adjacent_features(decoded, min_area, max_area)
