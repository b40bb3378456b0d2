"""From spots to intensity traces: one array of rounds * channels values per feature, round-major."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import nearest


def _trace(values: Column, rounds: int, channels: int, missing: float | None) -> Column:
    """Entries (index, value) as a dense array; cells without one hold `missing`."""
    m = F.map_from_entries(values)
    fill = F.lit(missing).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(rounds * channels - 1)), lambda i: F.coalesce(F.element_at(m, i), fill))


def exact_match(spots: DataFrame, rounds: int, channels: int) -> DataFrame:
    """Spots with the same id in every round and channel are one feature; its place is that of the first (r, c). Missing values are 0."""
    entry = F.struct((F.col("r") * channels + F.col("c")).alias("i"), F.col("intensity").cast("double").alias("v"))
    place = F.min_by(F.struct("z", "y", "x", "radius"), F.struct("r", "c")).alias("p")
    out = spots.groupBy("fov", "spot_id").agg(place, F.collect_list(entry).alias("e"))  # rounds * channels entries
    return out.select("fov", F.col("spot_id").alias("feature_id"), "p.*", _trace(F.col("e"), rounds, channels, 0.0).alias("trace"))


def sequential(spots: DataFrame, rounds: int, channels: int) -> DataFrame:
    """Every spot is a feature of its own, 0 but for its own round and channel. Features are numbered by round, channel and spot id.

    Numbers come from counts per round and channel, so no task sees a whole field of view's spots of
    all rounds at once.
    """
    group = ["fov", "r", "c"]
    counts = spots.groupBy(*group).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("fov").orderBy("r", "c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("spot_id")) - 1
    numbered = spots.withColumn("__rank", rank).join(counts.withColumn("__base", before).drop("__n"), group)
    cell = F.col("r") * channels + F.col("c")
    trace = F.transform(F.sequence(F.lit(0), F.lit(rounds * channels - 1)), lambda i: F.when(i == cell, F.col("intensity").cast("double")).otherwise(0.0))
    return numbered.select("fov", (F.col("__base") + F.col("__rank")).cast("long").alias("feature_id"), "z", "y", "x", "radius", trace.alias("trace"))


def nearest_neighbor(spots: DataFrame, rounds: int, channels: int, anchor_round: int = 1, search_radius: float = 3) -> DataFrame:
    """Each spot of the anchor round with the nearest spot (any channel) of every other round below search_radius; other cells are NULL.

    Several anchors may share a neighbour; equally near spots: the smallest id.
    """
    anchors = spots.where(F.col("r") == anchor_round).select("fov", F.col("spot_id").alias("feature_id"), "z", "y", "x", "radius", F.col("c").alias("ac"), F.col("intensity").alias("ai"))
    others = spots.where(F.col("r") != anchor_round).select("fov", "r", "c", "spot_id", "z", "y", "x", "intensity")
    found = nearest(anchors.select("fov", "feature_id", "z", "y", "x"), others, search_radius, ("feature_id",), ("r",), "spot_id")
    entry = F.struct((F.col("o_r") * channels + F.col("o_c")).alias("i"), F.col("o_intensity").cast("double").alias("v"))
    by_anchor = found.groupBy("fov", "feature_id").agg(F.collect_list(entry).alias("e"))  # one per round
    own = F.array(F.struct((F.lit(anchor_round) * channels + F.col("ac")).alias("i"), F.col("ai").cast("double").alias("v")))
    both = anchors.join(by_anchor, ["fov", "feature_id"], "left").withColumn("e", F.when(F.col("e").isNull(), own).otherwise(F.concat(own, "e")))
    return both.select("fov", "feature_id", "z", "y", "x", "radius", _trace(F.col("e"), rounds, channels, None).alias("trace"))


#: Strategies by name.
TRACE_BUILDERS = {"exact_match": exact_match, "sequential": sequential, "nearest_neighbor": nearest_neighbor}


def build_traces(spots: DataFrame, strategy: str, rounds: int, channels: int, **options) -> DataFrame:
    if strategy not in TRACE_BUILDERS:
        raise ValueError(f"strategy {strategy!r} is none of {sorted(TRACE_BUILDERS)}")
    return TRACE_BUILDERS[strategy](spots, rounds, channels, **(options if strategy == "nearest_neighbor" else {}))


def physical_coords(features: DataFrame, ticks: DataFrame) -> DataFrame:
    """features with xc, yc, zc: ticks interpolated linearly at x, y, z; NULL outside the axis; an axis of one tick only matches that tick.

    Ticks of an axis are collected into one array per field of view: an image's side, not its area.
    """
    axis = ticks.groupBy("fov").agg(*(F.sort_array(F.collect_list(F.when(F.col("axis") == a, F.struct("idx", "phys")))).alias(f"__{a}") for a in ("x", "y", "z")))
    out = features.join(axis, "fov", "left")
    for a in ("x", "y", "z"):
        t, at = F.col(f"__{a}"), F.col(a)
        low = F.floor(at).cast("int")
        first = t[0]["idx"]
        a0, a1 = F.try_element_at(t, low - first + 1)["phys"], F.try_element_at(t, low - first + 2)["phys"]
        inside = (at >= first) & (at <= F.element_at(t, -1)["idx"])
        out = out.withColumn(f"{a}c", F.when(inside & (at == low), a0).when(inside, a0 + (a1 - a0) * (at - low)))
    return out.drop("__x", "__y", "__z")


def pixel_features(pixels: DataFrame, channels: int | None = None, crop_x=None, crop_y=None, crop_z=None) -> DataFrame:
    """Every voxel as a feature with radius 0.5; features are numbered in order of z, y, x from 0 in each field of view.

    The number follows from the axes' sizes, so voxels need no sorting.
    """
    for a, bounds in (("x", crop_x), ("y", crop_y), ("z", crop_z)):
        if bounds is not None:
            pixels = pixels.where((F.col(a) >= bounds[0]) & (F.col(a) < bounds[1]))
    size = pixels.groupBy("fov").agg(*(F.min(a).alias(f"__{a}0") for a in ("z", "y", "x")), *((F.max(a) - F.min(a) + 1).alias(f"__{a}n") for a in ("y", "x")))
    traces = pixels.groupBy("fov", "z", "y", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "value"))), lambda s: s["value"]).alias("trace"))
    number = ((F.col("z") - F.col("__z0")) * F.col("__yn") + F.col("y") - F.col("__y0")) * F.col("__xn") + F.col("x") - F.col("__x0")
    return traces.join(size, "fov").select("fov", number.cast("long").alias("feature_id"), "z", "y", "x", F.lit(0.5).alias("radius"), "trace")


def zeros(features: DataFrame, rounds: int, channels: int) -> DataFrame:
    """features with traces of zeros."""
    return features.withColumn("trace", F.array_repeat(F.lit(0.0), rounds * channels))


def checked(features: DataFrame, rounds: int, channels: int) -> DataFrame:
    """features; a row whose trace isn't of rounds * channels values is an error when it is read."""
    n = rounds * channels
    text = F.concat(F.lit(f"traces must have {n} values, not "), F.size("trace").cast("string"))
    return features.withColumn("trace", F.when(F.size("trace") == n, F.col("trace")).otherwise(F.raise_error(text).cast("array<double>")))
