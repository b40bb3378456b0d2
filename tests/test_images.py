"""Image kernels, finders, segmentation, pixel decoding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatile.kernels import blobs, filters, regions, registration as reg
from lumatile.operators import find_spots, pixel_decode, registration, segment, tile_filters
from lumatile.operators.levels import Levels
from lumatile.operators.tiles import to_pixels, to_tiles
from lumatile.plans import pipelines
from lumatile.sources import codebook, experiment, tables


@pytest.fixture(scope="module")
def stack(spark):
    return experiment.from_numpy(spark, np.random.default_rng(1).random((2, 2, 2, 20, 24)) ** 20)


FILTERS = {
    "bandpass": dict(lshort=1, llong=3), "gaussian_low_pass": dict(sigma=1), "gaussian_high_pass": dict(sigma=1), "laplace": dict(sigma=1),
    "mean_high_pass": dict(size=3), "deconvolve_psf": dict(num_iter=2, sigma=1), "white_tophat": dict(masking_radius=2),
}


@pytest.mark.parametrize("volume", [False, True])
@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_shape_and_range(stack, name, volume):
    out = getattr(tile_filters, name)(stack, **FILTERS[name], is_volume=volume, method=Levels.SCALE_BY_IMAGE).collect()
    assert len(out) == 8
    values = np.array([r.pixels for r in out])
    assert values.shape == (8, 480) and values.min() >= 0 and values.max() == pytest.approx(1, abs=1e-6)


def test_sigma_must_fit_axes(stack):
    with pytest.raises(ValueError):
        tile_filters.gaussian_low_pass(stack, (1, 2, 3))
    with pytest.raises(ValueError):
        tile_filters.bandpass(stack, 1, 3, threshold=None)
    with pytest.raises(ValueError):
        filters.bandpass(np.ones((5, 5)), 1, 4)


def test_tiles_and_pixels_round_trip(stack):
    again = {(r.r, r.c, r.z): r.pixels for r in to_tiles(to_pixels(stack)).collect()}
    assert again == {(r.r, r.c, r.z): r.pixels for r in stack.collect()}


def test_gaussian_keeps_the_sum_of_an_inner_point():
    a = np.zeros((31, 31))
    a[15, 15] = 1
    out = filters.gaussian(a, 2)
    assert out.sum() == pytest.approx(1) and out.argmax() == a.argmax() and np.allclose(out, out.T)


def test_tophat_removes_what_is_larger_than_the_disk():
    a = np.full((30, 30), 0.3)
    a[10, 10] = 1
    assert np.argwhere(filters.white_tophat(a, 3)).tolist() == [[10, 10]]


def test_distance_and_labels_match_brute_force():
    rng = np.random.default_rng(2)
    m = rng.random((9, 11)) < 0.7
    bad = np.argwhere(~m)
    brute = np.array([[np.sqrt(((bad - [y, x]) ** 2).sum(axis=1)).min() for x in range(11)] for y in range(9)])
    assert np.allclose(regions.distance_transform(m), brute)
    lab, n = regions.label(m.astype(int), 1)
    todo, seen = {tuple(p) for p in np.argwhere(m)}, 0
    while todo:
        part, edge = set(), [todo.pop()]
        while edge:
            p = edge.pop()
            part.add(p)
            for d in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                if (q := (p[0] + d[0], p[1] + d[1])) in todo:
                    todo.remove(q)
                    edge.append(q)
        assert len({lab[p] for p in part}) == 1
        seen += 1
    assert seen == n


def test_watershed_splits_two_basins():
    a = np.abs(np.arange(11) - 5.0) * -1 + np.zeros((3, 1))
    markers = np.zeros((3, 11), int)
    markers[1, 0], markers[1, 10] = 1, 2
    out = regions.watershed(a, markers)
    assert (out[:, :5] == 1).all() and (out[:, 6:] == 2).all()


def test_polygon_with_edges():
    out = regions.fill_polygon(np.array([1, 1, 4, 4]), np.array([2, 5, 5, 2]), (7, 8))
    assert out.sum() == 16 and out[1:5, 2:6].all()


@pytest.mark.parametrize("upsampling", [1, 10])
def test_phase_shift(upsampling):
    a = filters.gaussian(np.random.default_rng(3).random((40, 40)), 1.5)
    assert reg.phase_shift(a, np.roll(a, (3, -5), (0, 1)), upsampling).tolist() == pytest.approx([-3, 5], abs=0.11)


def test_warp_by_half_a_pixel():
    a = np.arange(12.0).reshape(3, 4)
    assert reg.warp(a, reg.similarity(0.5, 0))[1, :3].tolist() == [4.5, 5.5, 6.5]


def test_transforms_round_trip(spark):
    t = spark.createDataFrame([("f", 1, None, None, "similarity", reg.similarity(1, 2))], "fov string, r int, c int, z int, type string, matrix array<double>")
    text = registration.transforms_to_json(t)
    assert registration.transforms_from_json(spark, text).collect() == t.collect()


def spot_volume(places, shape=(10, 60, 60), sigma=(1, 1.5, 1.5)):
    a = np.zeros(shape)
    for p in places:
        a[p] = 1
    a = filters.gaussian(a, sigma)
    return a / a.max() * 0.9


PLACES = [(4, 10, 50), (5, 50, 10), (5, 30, 30)]


@pytest.mark.parametrize("method", ["blob_log", "blob_dog"])
def test_blobs_find_planted_spots(spark, method):
    t = experiment.from_numpy(spark, spot_volume(PLACES)[None, None])
    out = find_spots.blob_detector(t, 1, 3, 5, 0.05, detector_method=method).collect()
    assert sorted((int(s.z), int(s.y), int(s.x)) for s in out) == sorted(PLACES)


def test_blobs_measured_everywhere_with_a_reference(spark):
    data = np.stack([spot_volume([p]) for p in PLACES])[:, None]
    t = experiment.from_numpy(spark, data)
    out = find_spots.blob_detector(t, 1, 3, 5, 0.05, reference=find_spots.projection(t))
    assert out.count() == 9
    assert out.where("intensity > 0.5").select("r", "spot_id").distinct().count() == 3
    assert find_spots.blob_detector(experiment.from_numpy(spark, np.zeros((1, 1, 2, 9, 9))), 1, 2, 2, 0.1).count() == 0
    with pytest.raises(ValueError):
        find_spots.blob_detector(t, 1, 2, 2, 0.1, detector_method="blob")
    with pytest.raises(ValueError):
        find_spots.blob_detector(t, 1, 2, 2, 0.1, detector_method="blob_doh")


def test_doh_finds_a_bright_disk():
    a = np.zeros((41, 41))
    yy, xx = np.mgrid[:41, :41]
    a[(yy - 20) ** 2 + (xx - 15) ** 2 <= 25] = 1
    found = blobs.blob_doh(a, 3, 6, 4, 0.005)
    assert len(found) and np.abs(found[0, :2] - [20, 15]).max() <= 1


def test_local_max_and_trackpy(spark):
    t = experiment.from_numpy(spark, (spot_volume(PLACES) + np.random.default_rng(0).random((10, 60, 60)) * 0.02)[None, None])
    out = find_spots.local_max_peak_finder(t, 3, 0, 3, 5000, min_num_spots_detected=2).collect()
    assert {(int(s.z), int(s.y), int(s.x)) for s in out} >= set(PLACES)
    out = find_spots.trackpy_local_max_peak_finder(t, (3, 5, 5), 1, 10, 6, percentile=99.5).collect()
    assert {(round(s.z), round(s.y), round(s.x)) for s in out} >= set(PLACES)
    with pytest.raises(ValueError):
        find_spots.trackpy_local_max_peak_finder(t, 3, 1, 10, 6, is_volume=False)


def test_min_distance_label_splits_touching_disks(spark):
    yy, xx = np.mgrid[:30, :40]
    m = ((yy - 15) ** 2 + (xx - 12) ** 2 <= 64) | ((yy - 15) ** 2 + (xx - 26) ** 2 <= 64)
    mask = tables.from_binary_arrays(spark, [m])
    assert segment.structural_label(mask).select("mask_id").distinct().count() == 1
    out = segment.min_distance_label(mask, 5)
    assert out.select("mask_id").distinct().count() == 2 and out.count() == m.sum()


def test_watershed_cells_end_to_end(spark):
    yy, xx = np.mgrid[:40, :60]
    disk = lambda y, x, r: (yy - y) ** 2 + (xx - x) ** 2 <= r * r
    nuclei, stain = np.zeros((1, 1, 1, 40, 60)), np.zeros((2, 2, 1, 40, 60))
    for y, x in ((20, 15), (20, 42)):
        nuclei[0, 0, 0][disk(y, x, 4)] = 0.9
        stain[:, :, 0, disk(y, x, 9)] = 0.6
    px = lambda a: to_pixels(experiment.from_numpy(spark, a))
    out = segment.watershed_cells(px(stain), px(nuclei), 0.5, 0.5, 3).groupBy("mask_id").agg(F.count("*").alias("n"), F.avg("x").alias("x")).orderBy("mask_id").collect()
    assert [r.n for r in out] == [int(disk(20, 15, 9).sum())] * 2 and [round(r.x) for r in out] == [15, 42]


def test_mean_traces_and_attributes(spark):
    names = dict(enumerate("abcdef", 1))
    grid = [[5, 4], [3, 2]]
    rows = [("f", z, y, x, names[grid[y][x]], [float(z), 1.0], 0.1, True) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    rows += [("f", 5, 9, 9, "a", [0.0, 0.0], 0.1, False), ("f", 5, 9, 8, "f", [0.0, 0.0], 0.1, False)]
    d = spark.createDataFrame(rows, "fov string, z int, y int, x int, target string, trace array<double>, distance double, passes_thresholds boolean")
    for distributed in (False, True):
        out = pixel_decode.combine_adjacent_features(d, 1, 3, distributed=distributed).orderBy("feature_id").collect()
        assert [(r.z, r.y, r.x, r.target, r.passes_thresholds) for r in out] == [(0, 0, 0, "e", True), (0, 0, 1, "d", True), (0, 1, 0, "c", True), (0, 1, 1, "b", True)]
        assert out[0].trace == [0.5, 1.0]
    assert pixel_decode.combine_adjacent_features(d.where("NOT passes_thresholds"), 1, 3).count() == 0


def test_pipelines_on_a_synthetic_scene(spark):
    codes = codebook.to_codes(codebook.synthetic_one_hot(spark, 3, 3, 8, seed=1), 3, 3)
    book = codebook.from_numpy(spark, ["p"], [[[1, 0], [0, 1]]])
    assert book.count() == 4
    spots = tables.synthetic_spots(spark, codes, 3, 3, 10, 60, 60, 1, seed=7)
    tiles = tables.synthetic_tiles(spots, 3, 3, 1, 60, 60, (0.0, 1.5, 1.5), seed=2)
    planted = {(round(s.y), round(s.x)): s.target for s in spots.select("y", "x", "target").distinct().collect()}
    found = pipelines.spot_pipeline(tiles, codes, 3, 3).where("passes_thresholds").collect()
    right = sum(any(abs(y - s.y) <= 2 and abs(x - s.x) <= 2 and t == s.target for (y, x), t in planted.items()) for s in found)
    assert right >= 7 and right >= 0.8 * len(found)
    pixels = pipelines.pixel_pipeline(tiles, codes, 9, min_area=2).where("passes_thresholds")
    assert pixels.count() >= 5


def test_probabilities_of_an_external_classifier_replace_planes(spark):
    rows = [("f", r, 0, z, 2, 3, [0.5] * 6) for r in range(2) for z in range(2)]
    tiles = spark.createDataFrame(rows, "fov string, r int, c int, z int, height int, width int, pixels array<float>")
    out = tile_filters.import_probabilities(tiles, lambda fov, r, c, z: np.full((2, 3), (r + z) / 4)).collect()
    assert {(x.r, x.z): set(x.pixels) for x in out} == {(r, z): {(r + z) / 4} for r in range(2) for z in range(2)}
    assert all((x.height, x.width, len(x.pixels)) == (2, 3, 6) for x in out)
