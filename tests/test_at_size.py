"""Cases that only larger tables have: means at a threshold, spots of no intensity, fields of view of many tiles."""

import itertools

import pytest
from pyspark.sql import functions as F

from lumatile.operators import decode, pixel_decode
from lumatile.plans import kernels, relational
from lumatile.sources import experiment, projections

#: Their sum differs with its order: only that of c gives 0.6 / 3.
AT = (0.1, 0.3, 0.2)


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_means_at_a_threshold_go_by_channel(spark, monkeypatch, order):
    """px4_decoded_image, F15: px6_attributes."""
    rows = [("f", 0, c, 0, 0, 0, AT[c]) for c in order]
    px = spark.createDataFrame(rows, "fov string, r int, c int, z int, y int, x int, value double").coalesce(1)
    monkeypatch.setattr(projections, "pixels", lambda *_: px)
    assert kernels._decoded_pixels(spark, "").first().distance == (AT[0] + AT[1] + AT[2]) / 3


def test_means_of_components_go_by_place(spark):
    """px5_mean_trace."""
    values = [0.1 * (i * 7 % 10) + 1e-17 * i + (1e6 if i == 5 else 0) for i in range(40)]
    total = 0.0
    for v in values:
        total += v
    for seed in range(3):
        d = spark.createDataFrame([("f", 0, i // 8, i % 8, [v, None], v) for i, v in enumerate(values)], "fov string, z int, y int, x int, trace array<double>, distance double").orderBy(F.rand(seed))
        found = pixel_decode.mean_pixel_traces(d, d.select("fov", "z", "y", "x", F.lit(1).alias("label"))).first()
        assert found.trace == [total / 40, None] and found.distance == total / 40


def test_spots_of_no_intensity(spark):
    """F16: dec5_metric_distance; the SQL compares them as zeros."""
    spots = spark.createDataFrame([("f", 0, 0, 0, 0.0, 0.0, 0.0, 1.0, 0.0), ("f", 0, 1, 1, 0.0, 0.0, 0.0, 1.0, 2.0)], "fov string, r int, c int, spot_id int, z double, y double, x double, radius double, intensity double")
    codes = spark.createDataFrame([(0, "A", [3.0, -4.0]), (1, "B", [1.0, 1.0])], "code_idx int, target string, trace array<double>")
    run = lambda **k: [(r.target, round(r.distance, 6), r.passes_thresholds) for r in decode.metric_distance(spots, codes, 1, 2, 1.2, 0.1, trace_building_strategy="sequential", **k).orderBy("feature_id").collect()]
    assert run(even_zeros=False) == [("A", 1.0, False), ("B", 0.765367, True)]
    assert run()[0][0] == "B"  # as an even trace


def test_query_compares_spots_of_no_intensity_as_zeros(spark, monkeypatch):
    """F16: dec5_metric_distance."""
    monkeypatch.setattr(projections, "spots", lambda *_: spark.createDataFrame([("f", 0, 0, 0, 0.0, 0.0, 0.0, 1.0, 0.0)], "fov string, r int, c int, spot_id int, z double, y double, x double, radius double, intensity double"))
    found = relational.dec5_metric_distance(spark, "/root/testdata/sf0.001").first()
    assert (found.target, found.distance) == ("G0", 1.0)


def test_fields_of_many_tiles_make_several_documents(spark):
    """snk9_manifest_roundtrip."""
    cols = "fov, image_type, r, c, z, height, width, file, tile_format, sha256, xc_min, xc_max, yc_min, yc_max, zc_min, zc_max"
    index = spark.range(300).selectExpr("concat('f', id % 2) AS fov", "'primary' AS image_type", "CAST(id AS INT) AS r", "0 AS c", "0 AS z", "4 AS height", "5 AS width", "concat('t', id) AS file", "'RAW' AS tile_format", "'0' AS sha256", *(f"1.0D AS {a}_{m}" for a in ("xc", "yc", "zc") for m in ("min", "max")))
    docs = experiment.fov_documents(index, 20)
    tiles, shapes = zip(*(tuple(r) for r in docs.selectExpr("size(from_json(value, 'tiles array<string>').tiles)", "get_json_object(value, '$.shape.r')").collect()), strict=True)
    assert sum(tiles) == 300 and max(tiles) < 60 and len(tiles) > 10 and set(shapes) == {"299", "300"}
    back = experiment.read_fov_documents(docs.withColumn("path", F.lit("x.json"))).selectExpr(*cols.split(", "))
    assert back.exceptAll(index).count() == 0 and index.exceptAll(back).count() == 0
    assert experiment.fov_documents(index).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_means_of_boxes_do_not_hang_on_order(spark, seed):
    """fs5_measure_mean."""
    from fractions import Fraction

    values = [0.1 * (i * 7 % 10) + 1e-3 * i for i in range(18)]
    exact = float(sum(map(Fraction, values)) / 18)
    rows = [("f", 0, 0, i // 9, i // 3 % 3, i % 3, v) for i, v in enumerate(values)] + [("f", 1, 0, 0, 0, 0, None), ("f", 2, 0, 0, 0, 0, float("inf")), ("f", 3, 0, 0, 0, 0, float("nan"))]
    px = spark.createDataFrame(rows, "fov string, r int, c int, z int, y int, x int, value double").orderBy(F.rand(seed))
    spots = spark.createDataFrame([("f", 0, 0, 7, 0.0, 1.0, 1.0, 2.0, 0.0)], "fov string, r int, c int, spot_id int, z double, y double, x double, radius double, intensity double")
    from lumatile.operators.spots import measure_across_imagestack

    found = {r.r: r.intensity for r in measure_across_imagestack(spots, px, "mean").collect()}
    assert found[0] == exact and found[1] is None and found[2] == float("inf") and found[3] != found[3]
