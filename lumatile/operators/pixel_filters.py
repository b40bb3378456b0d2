"""Filters that SQL can express over long pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import AXES
from .levels import Levels, level


def chunk_of(is_volume: bool) -> tuple[str, ...]:
    """Grouping of a filter: planes, or volumes of all planes of a round and channel."""
    return ("fov", "r", "c") if is_volume else ("fov", "r", "c", "z")


def _percentiles(pixels: DataFrame, keys: tuple[str, ...], *p: float) -> DataFrame:
    """pixels with columns p0, p1, ...: exact percentiles of their chunk, linear between values."""
    found = pixels.groupBy(*keys).agg(F.percentile("value", F.array(*(F.lit(x / 100) for x in p))).alias("__p"))
    return pixels.join(found.select(*keys, *(F.col("__p")[i].alias(f"p{i}") for i in range(len(p)))), list(keys))


def clip(pixels: DataFrame, p_min: float = 0, p_max: float = 100, is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    """Values limited to percentiles p_min and p_max of their chunk."""
    keys = chunk_of(is_volume)
    out = _percentiles(pixels, keys, p_min, p_max)
    return level(out.withColumn("value", F.least(F.greatest("value", "p0"), "p1")).select(*pixels.columns), method, keys)


def clip_percentile_to_zero(pixels: DataFrame, p_min: float = 0, p_max: float = 100, min_coeff: float = 1.0, max_coeff: float = 1.0, is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    """Values limited to min_coeff and max_coeff times these percentiles, less the lower limit."""
    keys = chunk_of(is_volume)
    out = _percentiles(pixels, keys, p_min, p_max)
    lo, hi = F.col("p0") * min_coeff, F.col("p1") * max_coeff
    return level(out.withColumn("value", F.least(F.greatest("value", lo), hi) - lo).select(*pixels.columns), method, keys)


def clip_value_to_zero(pixels: DataFrame, v_min: float = 0.0, v_max: float | None = None, is_volume: bool = False, method: Levels = Levels.CLIP) -> DataFrame:
    """Values limited to [v_min, v_max], less v_min."""
    v = F.greatest(F.col("value"), F.lit(float(v_min)))
    v = v if v_max is None else F.least(v, F.lit(float(v_max)))
    return level(pixels.withColumn("value", v - float(v_min)), method, chunk_of(is_volume))


def element_wise_multiply(pixels: DataFrame, factors: DataFrame, method: Levels = Levels.CLIP) -> DataFrame:
    """Multiply by factors (columns: any of the axes, and factor), which spread over the axes they lack."""
    if method in (Levels.SCALE_BY_CHUNK, Levels.SCALE_SATURATED_BY_CHUNK):
        raise ValueError("scaling by chunk has no meaning here")
    on = [a for a in ("fov", *AXES) if a in factors.columns]
    return level(pixels.join(factors, on).withColumn("value", F.col("value") * F.col("factor")).select(*pixels.columns), method)


def linear_unmixing(pixels: DataFrame, coeff: list[list[float]], method: Levels = Levels.CLIP) -> DataFrame:
    """out[j] = sum over channels i of value[i] * coeff[i][j], per round, plane, row and column."""
    matrix = pixels.sparkSession.createDataFrame([(i, j, float(v)) for i, row in enumerate(coeff) for j, v in enumerate(row)], "c int, j int, k double")
    out = pixels.join(F.broadcast(matrix), "c").groupBy("fov", "r", F.col("j").alias("c"), "z", "y", "x").agg(F.sum(F.col("value") * F.col("k")).alias("value"))
    return level(out.select(*pixels.columns), method, ("fov", "r", "z"))


def _over_channels(pixels: DataFrame) -> DataFrame:
    """pixels with norm, top and first (the smallest channel with the top value) over channels.

    A voxel's channels, a few values, travel together: one shuffle and one read of the pixels.
    """
    found = pixels.groupBy("fov", "r", "z", "y", "x").agg(
        F.collect_list(F.struct("c", "value")).alias("__v"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"),
        F.max("value").alias("top"), F.max_by("c", F.struct("value", -F.col("c"))).alias("first"),
    )
    return found.select("fov", "r", "z", "y", "x", "norm", "top", "first", F.inline("__v"))


def call_bases(pixels: DataFrame, intensity_threshold: float = 0, quality_threshold: float = 0) -> DataFrame:
    """The top channel gets its share of the L2 norm over channels, all others 0; 0 also below either threshold."""
    q = F.coalesce(F.try_divide("top", "norm"), F.lit(0.0))
    keep = (F.col("c") == F.col("first")) & (q >= quality_threshold) & (F.col("top") >= intensity_threshold)
    return level(_over_channels(pixels).withColumn("value", F.when(keep, q).otherwise(0.0)).select(*pixels.columns))


def zero_by_channel_magnitude(pixels: DataFrame, thresh: float, normalize: bool) -> DataFrame:
    """0 where the norm over channels is below thresh; else the value, divided by the norm if asked for."""
    v = F.coalesce(F.try_divide("value", "norm"), F.lit(0.0)) if normalize else F.col("value")
    return _over_channels(pixels).withColumn("value", F.when(F.col("norm") >= thresh, v).otherwise(0.0)).select(*pixels.columns)


def shift(pixels: DataFrame, shifts: DataFrame, height: int, width: int) -> DataFrame:
    """Translate by whole pixels: shifts has any of fov, r, c, z, and dy, dx. What comes in from outside is 0."""
    on = [a for a in ("fov", "r", "c", "z") if a in shifts.columns]
    moved = pixels.join(shifts, on, "left").na.fill(0, ["dy", "dx"])
    moved = moved.withColumn("y", (F.col("y") - F.col("dy")).cast("int")).withColumn("x", (F.col("x") - F.col("dx")).cast("int")).select(*pixels.columns)
    inside = moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return pixels.drop("value").join(inside, ["fov", *AXES], "left").na.fill(0.0, ["value"]).select(*pixels.columns)


def match_histograms(pixels: DataFrame, group_by: tuple[str, ...] = ("r", "c", "z")) -> DataFrame:
    """Chunks get the mean histogram: the n-th smallest value of each becomes the mean of all chunks' n-th smallest.

    Equal values of a chunk get one value: what the mean histogram holds at the share of values up
    to them. Chunks must be of one size.
    """
    from pyspark.sql import Window

    keys = ["fov", *group_by]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("value"))
    ranked = pixels.withColumn("__rank", rank)
    reference = ranked.groupBy("fov", "__rank").agg(F.avg("value").alias("__ref"))
    # A tie takes the place of its last member, as the share of values that are not larger.
    last = ranked.withColumn("__rank", F.max("__rank").over(Window.partitionBy(*keys, "value")))
    return last.join(reference, ["fov", "__rank"]).withColumn("value", F.col("__ref")).select(*pixels.columns)


def threshold_binarize(pixels: DataFrame, threshold: float) -> DataFrame:
    """(fov, mask_id, z, y, x): one mask per field of view of voxels at or above threshold; the stack must have one round and channel."""
    one = pixels.groupBy("fov").agg(F.countDistinct("r", "c").alias("__n")).where("__n > 1").limit(1)
    if one.count():
        raise ValueError("the stack must have one round and one channel")
    return pixels.where(F.col("value") >= threshold).select("fov", F.lit(0).alias("mask_id"), "z", "y", "x")


def intensity_histogram(pixels: DataFrame, bins: int = 10) -> DataFrame:
    """Counts of values in equal bins of [0, 1] by round and channel."""
    b = F.least(F.floor(F.col("value") * bins), F.lit(bins - 1)).cast("int")
    return pixels.groupBy("fov", "r", "c", b.alias("bin")).agg(F.count("*").alias("n"))
