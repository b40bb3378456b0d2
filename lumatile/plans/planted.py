"""Registered queries of finders, segmenters and pixel decoders over planted scenes, whose results SQL can tell from what was planted.

A scene is made of the supplier table: each supplier is a block of 16 x 16 pixels, four of them a
field of view, and key, nation and balance say what stands in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import find_spots, pixel_decode, segment
from ..operators.tiles import to_tiles
from ..sources import projections as P
from .relational import query, r6

#: The same in DuckDB: a block's field of view, corner, centre, brightness and sizes.
BLOCKS = """WITH b AS (SELECT 'fov_' || (s_suppkey // 4) AS fov, s_suppkey AS k, (s_suppkey % 4 * 16)::INT AS x0, (8 + s_nationkey % 3 - 1)::INT AS cy, (s_suppkey % 4 * 16 + 8 + s_suppkey % 3 - 1)::INT AS cx,
 0.5::DOUBLE + (s_nationkey % 5) * 0.1::DOUBLE AS amp, (s_nationkey % 5)::INT AS m FROM supplier)
"""
SIGMA = 1.5


def blocks(spark, sf) -> DataFrame:
    s, k = P.table(spark, sf, "supplier"), F.col("s_suppkey")
    number = lambda c: c.cast("int")
    return s.select(
        F.concat(F.lit("fov_"), F.floor(k / 4).cast("string")).alias("fov"), k.alias("k"), number(k % 4 * 16).alias("x0"), number(F.col("s_nationkey") % 3 + 7).alias("cy"), number(k % 4 * 16 + k % 3 + 7).alias("cx"),
        (F.col("s_nationkey") % 5 * F.lit(0.1) + 0.5).alias("amp"), number(F.col("s_nationkey") % 5).alias("m"),
    )


def block_pixels(spark, sf, value: Column, r: int = 0, c: int = 0) -> DataFrame:
    """Every pixel of every block in one round and channel; value may use fov, k, x0, cy, cx, amp, m, y and x."""
    i = blocks(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(255))))
    at = i.withColumns({"y": F.floor(F.col("i") / 16).cast("int"), "x": (F.col("x0") + F.col("i") % 16).cast("int")})
    return at.select("fov", F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(0).alias("z"), "y", "x", value.cast("double").alias("value"))


def _square(side: Column) -> Column:
    """Whether a pixel is in the square of that odd side around the block's centre."""
    half = (side - 1) / 2
    return (F.abs(F.col("y") - F.col("cy")) <= half) & (F.abs(F.col("x") - F.col("cx")) <= half)


def _spot(amp: Column) -> Column:
    d = F.pow(F.col("y") - F.col("cy"), F.lit(2)) + F.pow(F.col("x") - F.col("cx"), F.lit(2))
    return amp * F.exp(-d / (2 * SIGMA**2))


_FOUND = "SELECT fov, 0 AS r, 0 AS c, cy::DOUBLE AS y, cx::DOUBLE AS x, {} FROM b"
_PLACE = ("fov", "r", "c", "y", "x")


def _spots(spark, sf) -> DataFrame:
    return to_tiles(block_pixels(spark, sf, _spot(F.col("amp"))), "double")


@query(BLOCKS + _FOUND.format("2.0::DOUBLE AS radius, round(amp, 6) AS intensity"))
def fs1_planted_log(spark, sf):
    return r6(find_spots.blob_detector(_spots(spark, sf), 1, 2, 3, 0.1).select(*_PLACE, "radius", "intensity"))


@query(BLOCKS + _FOUND.format("round(amp, 6) AS intensity"))
def fs1_planted_dog(spark, sf):
    return r6(find_spots.blob_detector(_spots(spark, sf), 1, 4, 3, 0.05, detector_method="blob_dog").select(*_PLACE, "intensity"))


@query(BLOCKS + _FOUND.format("round(amp, 6) AS intensity"))
def fs1_planted_reference(spark, sf):
    """Found in a projection of two rounds, of which the first is darker, and measured in each."""
    both = block_pixels(spark, sf, _spot(F.col("amp"))).unionByName(block_pixels(spark, sf, _spot(F.col("amp") / 2), r=1))
    tiles = to_tiles(both, "double")
    found = find_spots.blob_detector(tiles, 1, 2, 3, 0.1, reference=find_spots.projection(tiles))
    return r6(found.where("r = 0").select(*_PLACE, "intensity"))


@query(BLOCKS + _FOUND.format("round(amp, 6) AS intensity"))
def fs1_planted_doh(spark, sf):
    return r6(find_spots.blob_detector(_spots(spark, sf), 2, 3, 2, 0.001, is_volume=False, detector_method="blob_doh").select(*_PLACE, "intensity"))


@query(BLOCKS + _FOUND.format("round(0.8::DOUBLE, 6) AS intensity"))
def fs2_planted_local_max(spark, sf):
    """Spots of one brightness above ripples of a tenth of it, which the threshold must tell apart."""
    ripple = F.when((F.col("y") % 5 == 2) & (F.col("x") % 5 == 2), 0.08).otherwise(0.0)
    tiles = to_tiles(block_pixels(spark, sf, F.greatest(_spot(F.lit(0.8)), ripple)), "double")
    return r6(find_spots.local_max_peak_finder(tiles, 2, 0, 4, 200, min_num_spots_detected=0).select(*_PLACE, "intensity"))


@query(BLOCKS + _FOUND.format("round(amp, 6) AS intensity"))
def fs3_planted_trackpy(spark, sf):
    return r6(find_spots.trackpy_local_max_peak_finder(_spots(spark, sf), 7, 0.5, 5, 5).select(*_PLACE, "intensity"))


# --- pixel decoding -----------------------------------------------------------------------------

_CODE = "(k % 9)"
_CALLED = f"""SELECT fov, 0 AS z, cy AS y, cx AS x, round(sqrt(4.0::DOUBLE * (2 * m + 1) ** 2 / pi()) / 2, 6) AS radius, ((2 * m + 1) ** 2)::BIGINT AS area, 'G' || {_CODE} AS target, {{}} AS distance, m BETWEEN 1 AND 3 AS passes_thresholds FROM b"""
_SPOT = ("fov", "z", "y", "x", "radius", "area", "target", "distance", "passes_thresholds")


def _channel(r: int, code: Column) -> Column:
    return (code + r * (1 + F.floor(code / 3))) % 3


def _squares(spark, sf) -> DataFrame:
    """Squares of sides 1 to 9 that shine in one channel a round."""
    inside, parts = _square(2 * F.col("m") + 1), []
    for r in range(3):
        for c in range(3):
            parts.append(block_pixels(spark, sf, F.when(inside & (_channel(r, F.col("k") % 9) == c), F.col("amp")).otherwise(0.0), r, c))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(BLOCKS + _CALLED.format("0.0::DOUBLE"))
def px1_planted_squares(spark, sf):
    """Whole images to spots: each square is one, of its code, and passes if its area is from 9 to 49."""
    code = lambda j: [1.0 if (j + r * (1 + j // 3)) % 3 == c else 0.0 for r in range(3) for c in range(3)]
    codes = spark.createDataFrame([(j, f"G{j}", code(j)) for j in range(9)], "code_idx int, target string, trace array<double>")
    return r6(pixel_decode.pixel_spot_decoder(_squares(spark, sf), codes, 9, "euclidean", 0.1, 0.2, 9, 50).select(*_SPOT))


@query(BLOCKS + _CALLED.format("round((k % 4) * 0.05::DOUBLE, 6)"))
def px7_planted_squares(spark, sf):
    """Decoded pixels to spots; pixels outside the squares have targets but don't pass."""
    i = blocks(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(255))))
    at = i.withColumns({"y": F.floor(F.col("i") / 16).cast("int"), "x": (F.col("x0") + F.col("i") % 16).cast("int")})
    decoded = at.select("fov", (F.col("y") * 64 + F.col("x")).cast("long").alias("feature_id"), F.lit(0).alias("z"), "y", "x", F.array(F.col("amp")).alias("trace"), F.concat(F.lit("G"), (F.col("k") % 9).cast("string")).alias("target"), (F.col("k") % 4 * F.lit(0.05)).alias("distance"), _square(2 * F.col("m") + 1).alias("passes_thresholds"))
    return r6(pixel_decode.combine_adjacent_features(decoded, 9, 50).select(*_SPOT))


# --- segmentation -------------------------------------------------------------------------------

_ID = "(row_number() OVER (PARTITION BY fov ORDER BY {}) - 1)::INT AS mask_id"


def _pixels_where(spark, sf, inside: Column) -> DataFrame:
    return block_pixels(spark, sf, inside.cast("int")).where("value = 1").select("fov", F.lit(0).alias("mask_id"), "z", "y", "x")


@query(BLOCKS + f"SELECT fov, mask_id, 0 AS z, y::INT AS y, x::INT AS x FROM (SELECT *, {_ID.format('cy, cx')} FROM b), range(0, 16) p(y), range(0, 64) q(x) WHERE abs(y - cy) <= m AND abs(x - cx) <= m")
def mo3_planted_squares(spark, sf):
    """Squares apart from each other are a region each, in order of their middles."""
    return segment.min_distance_label(_pixels_where(spark, sf, _square(2 * F.col("m") + 1)), 5)


_BARS = "SELECT b.*, x0 + 1 AS a, m + 2 AS h FROM b"


@query(BLOCKS + f"SELECT fov, ((k % 4) * 2 + (CASE WHEN x - a < h THEN 0 ELSE 1 END))::INT AS mask_id, 0 AS z, y::INT AS y, x::INT AS x FROM ({_BARS}), range(0, 16) p(y), range(0, 64) q(x) WHERE abs(y - cy) <= 1 AND x - a >= 0 AND x - a < 2 * h")
def mo8_planted_bars(spark, sf):
    """Bars that darken towards their middle, flooded from both ends: each end gets a half."""
    px, h = F.col("x") - F.col("x0") - 1, F.col("m") + 2
    bar = (F.abs(F.col("y") - F.col("cy")) <= 1) & (px >= 0) & (px < 2 * h)
    image = block_pixels(spark, sf, F.when(bar, 1 - 0.05 * F.least(px, 2 * h - 1 - px)).otherwise(0.0))
    ends = F.when(bar & (px == 0), F.col("k") % 4 * 2 + 1).when(bar & (px == 2 * h - 1), F.col("k") % 4 * 2 + 2).otherwise(0)
    markers = block_pixels(spark, sf, ends).where("value > 0").select("fov", (F.col("value") - 1).cast("int").alias("mask_id"), "z", "y", "x")
    return segment.watershed_segment(image, markers, _pixels_where(spark, sf, bar))


@query(BLOCKS + f"SELECT fov, mask_id, 0 AS z, y::INT AS y, x::INT AS x FROM (SELECT *, {_ID.format('cy, cx')} FROM b WHERE m > 0), range(0, 16) p(y), range(0, 64) q(x) WHERE abs(y - cy) <= 4 AND abs(x - cx) <= 4")
def mo9_planted_cells(spark, sf):
    """Cells of one size around nuclei; a nucleus of a single pixel is too small, so its cell isn't found."""
    stain = lambda v, r: block_pixels(spark, sf, F.when(_square(F.lit(9)), v).otherwise(0.0), r)
    nuclei = block_pixels(spark, sf, F.when(_square(F.when(F.col("m") > 0, 3).otherwise(1)), 0.7).otherwise(0.1))
    return segment.watershed_cells(stain(0.8, 0).unionByName(stain(0.4, 1)), nuclei, 0.5, 0.5, None, (4, 10_000))
