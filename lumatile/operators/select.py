"""Selection: by label, by position, by physical coordinate; crops; fields of view; shapes and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AXES, LABELLED, PHYSICAL

Index = int | tuple[int | None, int | None] | list[int]


def _condition(c: Column, index: Index, inclusive: bool) -> Column:
    if isinstance(index, tuple):
        lo, hi = index
        above = F.lit(True) if lo is None else c >= lo
        below = F.lit(True) if hi is None else (c <= hi if inclusive else c < hi)
        return above & below
    return c.isin(*index) if isinstance(index, list) else c == index


def sel(pixels: DataFrame, indexers: dict[str, Index]) -> DataFrame:
    """By label: an int, a list, or (lo, hi). r, c and z ranges include hi; y and x have no labels, so theirs are positions without hi."""
    for axis, index in indexers.items():
        if axis not in AXES:
            raise ValueError(f"no axis {axis!r}")
        pixels = pixels.where(_condition(F.col(axis), index, axis in LABELLED))
    return pixels


def positions(pixels: DataFrame, axis: str) -> DataFrame:
    """(fov, label, position): the axis' labels in order. As many rows as there are labels."""
    labels = pixels.select("fov", F.col(axis).alias("label")).distinct()
    return labels.withColumn("position", F.row_number().over(Window.partitionBy("fov").orderBy("label")) - 1)


def isel(pixels: DataFrame, indexers: dict[str, Index]) -> DataFrame:
    """By position along each axis, hi excluded; negative ints count from the end."""
    for axis, index in indexers.items():
        at = positions(pixels, axis)
        if isinstance(index, int) and index < 0:
            at = at.withColumn("position", F.col("position") - F.count("*").over(Window.partitionBy("fov")))
        chosen = at.where(_condition(F.col("position"), index, False)).select("fov", F.col("label").alias(axis))
        pixels = pixels.join(chosen, ["fov", axis], "left_semi")
    return pixels


def nearest_tick(ticks: DataFrame, axis: str, value: float) -> DataFrame:
    """(fov, idx): the tick of the axis nearest to value, the first of equally near ones."""
    far = F.abs(F.col("phys") - F.lit(float(value)))
    return ticks.where(F.col("axis") == axis).groupBy("fov").agg(F.min_by("idx", F.struct(far, "idx")).alias("idx"))


def sel_by_physical_coords(pixels: DataFrame, ticks: DataFrame, indexers: dict[str, float | tuple[float, float]]) -> DataFrame:
    """By physical coordinate (xc, yc, zc): a value takes its nearest tick, a range those from the nearest tick of its start to that of its end, excluded."""
    for name, index in indexers.items():
        axis = PHYSICAL[name]
        lo, hi = index if isinstance(index, tuple) else (index, None)
        first = nearest_tick(ticks, axis, lo).withColumnRenamed("idx", "__lo")
        pixels = pixels.join(first, "fov")
        if hi is None:
            pixels = pixels.where(F.col(axis) == F.col("__lo")).drop("__lo")
        else:
            last = nearest_tick(ticks, axis, hi).withColumnRenamed("idx", "__hi")
            pixels = pixels.join(last, "fov").where((F.col(axis) >= F.col("__lo")) & (F.col(axis) < F.col("__hi"))).drop("__lo", "__hi")
    return pixels


def set_slice(pixels: DataFrame, patch: DataFrame) -> DataFrame:
    """pixels with the values of patch where it has the same voxel; patch values must lie in [0, 1]."""
    keys = ["fov", *AXES]
    checked = patch.select(*keys, F.when(F.col("value").between(0, 1), F.col("value")).otherwise(F.raise_error(F.lit("values must lie in [0, 1]")).cast("double")).alias("__new"))
    return pixels.join(checked, keys, "left").withColumn("value", F.coalesce("__new", "value")).select(*pixels.columns)


def codebook_partial(codebook: DataFrame, indexers: dict[str, Index]) -> DataFrame:
    """Rows of a long codebook in the given rounds and channels, renumbered from 0 in order."""
    for axis, index in indexers.items():
        chosen = codebook.where(_condition(F.col(axis), index, True))
        labels = chosen.select(axis).distinct().withColumn("__new", (F.row_number().over(Window.orderBy(axis)) - 1).cast("int"))  # rounds or channels: a few
        codebook = chosen.join(labels, axis).withColumn(axis, F.col("__new")).drop("__new").select(*codebook.columns)
    return codebook


def crop_bounds(index: int | tuple[int | None, int | None] | None, size: int) -> tuple[int, int]:
    """[start, stop) of a crop of an axis of the given size; negative numbers count from the end, ranges are clamped."""
    if index is None:
        return 0, size
    if isinstance(index, int):
        at = index + size if index < 0 else index
        if not 0 <= at < size:
            raise IndexError(f"{index} is out of range for {size}")
        return at, at + 1
    lo, hi, _ = slice(*index).indices(size)
    return lo, max(lo, hi)


def crop(pixels: DataFrame, rounds: list[int] | None = None, chs: list[int] | None = None, zplanes: list[int] | None = None, y=None, x=None, height: int = 0, width: int = 0) -> DataFrame:
    """Load-time crop. Permitted rounds, channels and planes combine as a cross-product; cropped y and x start at 0 again.

    height and width are needed for negative or single positions.
    """
    for axis, allowed in (("r", rounds), ("c", chs), ("z", zplanes)):
        if allowed is not None:
            pixels = pixels.where(F.col(axis).isin(*allowed))
    for axis, index, size in (("y", y, height), ("x", x, width)):
        if index is not None:
            lo, hi = crop_bounds(index, size)
            pixels = pixels.where((F.col(axis) >= lo) & (F.col(axis) < hi)).withColumn(axis, F.col(axis) - F.lit(lo))
    return pixels


def aligned_groups(tiles: DataFrame) -> DataFrame:
    """tiles (fov, r, c, z, xmin, xmax, ymin, ymax, ...) with aligned_group: 0 for the extent seen first in order of r, c, z, and so on."""
    extent = ["xmin", "xmax", "ymin", "ymax"]
    first = tiles.groupBy("fov", *extent).agg(F.min(F.struct("r", "c", "z")).alias("__first"))
    number = (F.row_number().over(Window.partitionBy("fov").orderBy("__first")) - 1).cast("int")  # a row per extent
    return tiles.join(first.withColumn("aligned_group", number).drop("__first"), ["fov", *extent]).select(*tiles.columns, "aligned_group")


def fovs(experiment: DataFrame, predicate: Column | None = None, key: str | Column = "fov") -> DataFrame:
    """Distinct fields of view that pass, in order."""
    out = experiment.select("fov").distinct()
    return (out if predicate is None else out.where(predicate)).orderBy(key)


def fov(experiment: DataFrame, predicate: Column | None = None, key: str | Column = "fov") -> str:
    """The first field of view that passes; LookupError if none does."""
    if not (found := fovs(experiment, predicate, key).limit(1).collect()):
        raise LookupError("no field of view passes")
    return found[0].fov


def tile_metadata(tiles: DataFrame) -> DataFrame:
    """fov, r, c, z, the tile's extras, and barcode_index = ((z * R) + r) * C + c with R and C the field's numbers of rounds and channels."""
    size = tiles.groupBy("fov").agg(F.countDistinct("r").alias("__r"), F.countDistinct("c").alias("__c"))
    index = ((F.col("z") * F.col("__r") + F.col("r")) * F.col("__c") + F.col("c")).cast("long")
    out = tiles.join(size, "fov")
    keep = ["fov", *LABELLED, *(["extras"] if "extras" in tiles.columns else [])]
    if "extras" in tiles.columns:
        clash = F.exists(F.map_keys("extras"), lambda k: k.isin(*LABELLED))
        out = out.where(F.when(clash, F.raise_error(F.lit("extras may not be named like axes")).cast("boolean")).otherwise(True))
        own = F.coalesce(F.element_at("extras", "barcode_index").cast("long"), index)
        return out.select(*keep, own.alias("barcode_index"))
    return out.select(*keep, index.alias("barcode_index"))


def shape(pixels: DataFrame) -> DataFrame:
    """Numbers of rounds, channels, planes, rows and columns by field of view."""
    return pixels.groupBy("fov").agg(*(F.countDistinct(a).alias(f"num_{a}") for a in AXES))


def axis_labels(pixels: DataFrame, axis: str) -> DataFrame:
    """The sorted labels of an axis by field of view, as an array."""
    return pixels.groupBy("fov").agg(F.sort_array(F.collect_set(axis)).alias("labels"))


def code_length(codes: DataFrame) -> DataFrame:
    """Rounds times channels of a codebook of traces."""
    return codes.agg(F.max(F.size("trace")).cast("long").alias("code_length"))


def area_filter(mask_pixels: DataFrame, min_area: int | None = None, max_area: int | None = None) -> DataFrame:
    """Masks with min_area <= area <= max_area; both bounds are inclusive and may be missing."""
    if min_area is not None and max_area is not None and min_area > max_area:
        raise ValueError("min_area exceeds max_area")
    area = mask_pixels.groupBy("fov", "mask_id").agg(F.count("*").alias("__area"))
    keep = area.where(_condition(F.col("__area"), (min_area, max_area), True))
    return mask_pixels.join(keep.drop("__area").hint("merge"), ["fov", "mask_id"], "left_semi")


def passing(decoded: DataFrame) -> DataFrame:
    return decoded.where("passes_thresholds")


def to_features_dataframe(features: DataFrame) -> DataFrame:
    """Per-feature columns, without traces."""
    return features.drop("trace")


def to_decoded_dataframe(decoded: DataFrame) -> DataFrame:
    """Per-feature columns with physical coordinates, without pixel coordinates, ids and traces."""
    return decoded.drop("trace", "feature_id", "x", "y", "z")
