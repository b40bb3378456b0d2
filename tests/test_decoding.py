"""Hand-checked cases of decoding, levels, reduction and overlap."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumatile.operators import assign, check_all, decode, pixel_decode, pixel_filters, reduce, select, traces
from lumatile.operators.levels import Levels, level, preserve_float_range
from lumatile.sources import codebook

A = [0.0, 1.0, 1.0, 0.0]  # (round 0, channel 1), (round 1, channel 0)
B = [0.0, 0.0, 1.0, 1.0]


def features(spark, *data):
    return spark.createDataFrame([("f", i, [None if v is None else float(v) for v in t]) for i, t in enumerate(data)], "fov string, feature_id long, trace array<double>")


def codes(spark, *data):
    return spark.createDataFrame([(i, t, [float(v) for v in c]) for i, (t, c) in enumerate(data)], "code_idx int, target string, trace array<double>")


def result(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("feature_id").collect()]


def test_metric_decode(spark):
    f = features(spark, [0, 4, 3, 0], [0, 0, 0.4, 0.3], [30, 0, 0, 40])
    out = decode.decode_metric(f, codes(spark, ("A", A), ("B", B)), 4, 0.5, 1, norm_order=1)
    assert result(out, "target", "passes_thresholds") == [("A", True), ("B", False), ("B", False)]


def test_nearest_code_takes_first_of_a_tie(spark):
    f = features(spark, [0, 0.5, 0.5, 0], [0, 0, 0.5, 0.5], [0.5, 0.5, 0, 0], [0, 0.5, 0, 0.5])
    out = decode.nearest_code(f, codes(spark, ("A", A), ("B", B)))
    assert result(out, "target") == [("A",), ("B",), ("A",), ("A",)]


def test_large_codebooks_are_compared_in_steps(spark, monkeypatch):
    import random

    r = random.Random(1)
    book = codes(spark, *((f"T{i}", [r.random() for _ in range(4)]) for i in range(30)))
    f = features(spark, *([r.random() for _ in range(4)] for _ in range(50)))
    whole = result(decode.nearest_code(f, book), "target", "distance")
    monkeypatch.setattr(decode, "BROADCAST_CODES", 7)
    assert result(decode.nearest_code(f, book), "target", "distance") == whole
    assert result(decode.decode_per_round_max(f, book, 2, 2), "target") == result(decode.decode_per_round_max(f, book, 2, 2), "target")


@pytest.mark.parametrize("metric", decode.PRODUCTS)
def test_products_equal_distances_row_by_row(spark, metric):
    """Ties, equal codes, a null trace and vectors of zeros included."""
    r = random.Random(3)
    book = codes(spark, *((f"T{i}", [r.choice([0, 0, 0.5, 1]) for _ in range(4)]) for i in range(40)), ("zero", [0] * 4), ("again", [1, 0, 0.5, 0]))
    f = features(spark, *([r.choice([0, 0.5, 1, r.random()]) for _ in range(4)] for _ in range(200)), [0] * 4)
    f = f.unionByName(f.limit(1).withColumn("trace", F.lit(None).cast("array<double>")).withColumn("feature_id", F.lit(999).cast("long")))
    best = f.withColumn("__best", F.lit(None).cast("struct<d:double,i:int,t:string>"))
    named = book.where("target <> 'zero'") if metric == "cosine" else book
    a = {x.feature_id: x["__best"] for x in decode._nearest_in_row(best.where("trace IS NOT NULL"), named, metric).collect()}
    b = {x.feature_id: x["__best"] for x in decode._nearest_by_product(best, named, metric).collect()}
    assert b.pop(999) is None and a.keys() == b.keys()
    for k, x in a.items():
        assert (x.i, x.t) == (b[k].i, b[k].t) and (x.d is None and b[k].d is None or x.d == pytest.approx(b[k].d, abs=1e-12))


@pytest.mark.parametrize(("order", "expected"), [(1, 7.0), (2, 5.0)])
def test_norms(spark, order, expected):
    out = decode.normalize_features(features(spark, [0, 3, 4, 0], [0, 0, 0, 0]), 4, order).orderBy("feature_id").collect()
    assert out[0].norm == expected
    assert out[1].trace == pytest.approx([0.25 if order == 1 else 4**-1.5] * 4)


def test_infinite_norm(spark):
    out = decode.normalize_features(features(spark, [0, -3, 4, 0]), 4, float("inf")).first()
    assert out.norm == 4 and out.trace == [0, -0.75, 1, 0]


@pytest.mark.parametrize(
    ("data", "expected"),
    [
        ([0, 3, 4, 0], ("A", True, 0.0)), ([3, 0, 0, 4], (None, False, 0.0)), ([4, 3, 4, 0], (None, False, None)),
        ([0, 3, 4, 3], ("A", True, None)), ([0, 1, 1, 1], (None, False, None)), ([0, 1, 1, 0], ("A", True, 0.0)), ([0, 1, None, None], (None, False, None)),
    ],
)
def test_per_round_max(spark, data, expected):
    out = result(decode.decode_per_round_max(features(spark, data), codes(spark, ("A", A), ("B", [0, 1, 0, 1])), 2, 2), "target", "passes_thresholds", "distance")[0]
    assert out[:2] == expected[:2]
    assert expected[2] is None or out[2] == pytest.approx(expected[2])


def test_last_of_equal_codes_wins(spark):
    out = decode.decode_per_round_max(features(spark, A), codes(spark, ("A", A), ("Z", A)), 2, 2)
    assert result(out, "target") == [("Z",)]


def test_one_channel_never_decodes(spark):
    assert result(decode.decode_per_round_max(features(spark, [1, 1]), codes(spark, ("A", [1, 1])), 2, 1), "target") == [(None,)]


@pytest.mark.parametrize(
    ("values", "clip", "rescale", "saturated"),
    [((0, 1, 2), (0, 1, 1), (0, 0.5, 1), (0, 0.5, 1)), ((0, 0.25, 0.5), (0, 0.25, 0.5), (0, 0.5, 1), (0, 0.25, 0.5)), ((-1, 0, 1, 2), (0, 0, 1, 1), (0, 0, 0.5, 1), (0, 0, 0.5, 1))],
)
def test_levels(spark, values, clip, rescale, saturated):
    px = spark.createDataFrame([("f", 0, 0, 0, 0, i, float(v)) for i, v in enumerate(values)], "fov string, r int, c int, z int, y int, x int, value double")
    get = lambda df: tuple(r.value for r in df.orderBy("x").collect())
    assert get(level(px)) == clip
    assert get(preserve_float_range(px, rescale=True)) == rescale == get(level(px, Levels.SCALE_BY_CHUNK))
    assert get(preserve_float_range(px, rescale_saturated=True)) == saturated
    with pytest.raises(ValueError):
        preserve_float_range(px, True, True)


def test_level_of_zeros_stays(spark):
    px = spark.createDataFrame([("f", 0, 0, 0, 0, 0, 0.0)], "fov string, r int, c int, z int, y int, x int, value double")
    assert level(px, Levels.SCALE_BY_IMAGE).first().value == 0


@pytest.mark.parametrize(("func", "expected"), [("max", (0.75, 1.0, 0.1)), ("mean", (0.425, 0.55, 0.1)), ("sum", (0.85, 1.0, 0.2)), ("norm", (0.7566373, 1.0, 0.1414214))])
def test_reduce_over_rounds(spark, func, expected):
    rows = [("f", r, c, 0, y, x, 0.1 if r else 0.75 if c == 0 and (y, x) == (0, 0) else 1.0 if (y, x) == divmod(c, 2) else 0.1) for r in (0, 1) for c in range(4) for y in (0, 1) for x in (0, 1)]
    out = reduce.reduce(spark.createDataFrame(rows, "fov string, r int, c int, z int, y int, x int, value double"), ("r",), func)
    got = {(r.c, r.y, r.x): r.value for r in out.collect()}
    assert (got[0, 0, 0], got[1, 0, 1], got[0, 1, 1]) == pytest.approx(expected, abs=1e-6)


def test_linear_unmixing(spark):
    rows = [("f", 0, c, 0, 0, x, 0.0 if c == x == 0 else 1.0) for c in range(3) for x in range(2)]
    px = spark.createDataFrame(rows, "fov string, r int, c int, z int, y int, x int, value double")
    out = {(r.c, r.x): r.value for r in pixel_filters.linear_unmixing(px, [[1, -0.25, 0], [-0.25, 1, -0.25], [-0.1, 0, 1]]).collect()}
    assert [out[c, 1] for c in range(3)] == pytest.approx([0.65, 0.75, 0.75])
    assert [out[c, 0] for c in range(2)] == pytest.approx([0, 1])


def test_call_bases(spark):
    rows = [("f", 0, c, 0, y, x, (0.75 if (y, x) == (0, 0) else 1.0) if c == 2 * y + x else 0.5) for c in range(4) for y in (0, 1) for x in (0, 1)]
    px = spark.createDataFrame(rows, "fov string, r int, c int, z int, y int, x int, value double")
    out = {(r.c, r.y, r.x): r.value for r in pixel_filters.call_bases(px, 0.8).collect()}
    assert out[0, 0, 0] == 0 and out[3, 1, 1] == pytest.approx(0.755929, abs=1e-6) and out[0, 1, 1] == 0


def test_zero_by_magnitude_above_all(spark):
    px = spark.createDataFrame([("f", 0, c, 0, 0, x, x / 10) for c in (0, 1) for x in range(11)], "fov string, r int, c int, z int, y int, x int, value double")
    assert pixel_filters.zero_by_channel_magnitude(px, math.inf, False).agg(F.max("value")).first()[0] == 0


def test_overlaps_and_take_max(spark):
    line = lambda fov, n, x0, x1, y0, y1: [(fov, i, x0 + (x1 - x0) * i / (n - 1), y0 + (y1 - y0) * i / (n - 1)) for i in range(n)]
    f = spark.createDataFrame(line("a", 10, 0, 2, 0, 2) + line("b", 20, 1, 2, 1, 3), "fov string, feature_id long, xc double, yc double")
    assert assign.overlaps(f).collect()[0][2:] == (1.0, 2.0, 1.0, 2.0)
    for strategy in assign.OVERLAP_STRATEGIES:
        out = assign.concatenate_intensity_tables([f.where("fov = 'a'"), f.where("fov = 'b'")], strategy)
        assert {r.fov: r["count"] for r in out.groupBy("fov").count().collect()} == {"a": 6, "b": 20}
    with pytest.raises(ValueError):
        assign.concatenate_intensity_tables([f], "take_min")


@pytest.mark.parametrize("seed", range(3))
def test_take_max_equals_pair_by_pair(spark, seed):
    """Fields in a grid that overlap on all sides, so that pairs depend on earlier ones."""
    r = random.Random(seed)
    rows = [(f"{k}", i, 8.0 * (k % 3) + r.randint(0, 10), 8.0 * (k // 3) + r.randint(0, 10)) for k in range(9) for i in range(r.randint(5, 60))]
    left = {f: [x for x in rows if x[0] == f] for f in sorted({x[0] for x in rows})}
    box = lambda t: (min(x[2] for x in t), max(x[2] for x in t), min(x[3] for x in t), max(x[3] for x in t))
    changed = 0
    for a in left:
        for b in left:
            if a < b and left[a] and left[b]:
                p, q = box(left[a]), box(left[b])
                x0, x1, y0, y1 = max(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), min(p[3], q[3])
                if x0 <= x1 and y0 <= y1:
                    n = [sum(x0 <= x[2] <= x1 and y0 <= x[3] <= y1 for x in left[f]) for f in (a, b)]
                    lose = b if n[0] >= n[1] else a
                    left[lose] = [x for x in left[lose] if not (x0 < x[2] < x1 and y0 < x[3] < y1)]
                    changed += 1
    f = spark.createDataFrame(rows, "fov string, feature_id long, xc double, yc double").repartition(3)
    got = {(x.fov, x.feature_id) for x in assign.take_max(f).collect()}
    assert got == {x[:2] for t in left.values() for x in t} and changed > 10


def test_waves_keep_the_order_of_pairs_that_share_a_field():
    pairs = [("0", "1"), ("0", "3"), ("1", "2"), ("4", "5"), ("2", "3")]
    assert assign.waves(pairs) == [[("0", "1"), ("4", "5")], [("0", "3"), ("1", "2")], [("2", "3")]]


def test_long_components_settle(spark):
    """A line that winds over fifteen rows is one component, whichever way it is found."""
    winding = [(0, 2 * row, x) for row in range(15) for x in range(40)] + [(0, 2 * row + 1, 39 * (1 - row % 2)) for row in range(14)]
    image = spark.createDataFrame([("f", z, y, x, 1) for z, y, x in winding] + [("f", 0, 50, 50, 1), ("f", 1, 51, 50, 1), ("f", 0, 50, 51, 2), ("g", 0, 0, 0, 3)], "fov string, z int, y int, x int, code int")
    both = [sorted(tuple(x) for x in f(image).collect()) for f in (pixel_decode.label_components, pixel_decode.label_components_sql)]
    assert both[0] == both[1] and len({x[5] for x in both[0] if x[0] == "f"}) == 3


def test_overlap_pairs(spark):
    boxes = {"0": (0, 1, 0, 1), "1": (0.5, 2, 0.5, 1.5), "2": (1.5, 2.5, 0, 1), "3": (0, 1, 1, 2)}
    rows = [(k, i, float(x), float(y)) for k, (a, b, c, d) in boxes.items() for i, (x, y) in enumerate([(a, c), (b, d)])]
    pairs = assign.overlaps(spark.createDataFrame(rows, "fov string, feature_id long, xc double, yc double"))
    assert {(p.fov_a, p.fov_b) for p in pairs.collect()} == {("0", "1"), ("1", "2"), ("1", "3"), ("0", "3")}


def test_concatenated_matrices_leave_missing_genes_null(spark):
    a = spark.createDataFrame([("1", 0, 1), ("2", 1, 0)], "cell_id string, x long, y long")
    b = spark.createDataFrame([("3", 0), ("4", 1)], "cell_id string, x long")
    assert [tuple(r)[1:] for r in assign.concatenate_expression([a, b]).orderBy("cell_id").collect()] == [(0, 1), (1, 0), (0, None), (1, None)]


@pytest.mark.parametrize(("anchor", "radius", "filled"), [(1, 3, 3), (0, 1, 1)])
def test_nearest_neighbour_traces(spark, anchor, radius, filled):
    rows = [("f", r, 0, r, float(z), float(y), float(x), 1.0, 1.0) for r, (z, y, x) in enumerate([(5, 35, 35), (5, 34, 35), (6, 35, 33)])]
    s = spark.createDataFrame(rows, "fov string, r int, c int, spot_id long, z double, y double, x double, radius double, intensity double")
    out = traces.nearest_neighbor(s, 3, 1, anchor, radius).collect()
    assert len(out) == 1 and sum(v is not None for v in out[0].trace) == filled


def test_physical_coordinates(spark):
    ticks = spark.createDataFrame([("f", a, i, 10.0 + 2 * i) for a in "xy" for i in range(3)] + [("f", "z", 0, 5.0)], "fov string, axis string, idx int, phys double")
    f = spark.createDataFrame([("f", 0, 0.0, 0.5, 2.0), ("f", 1, 0.0, 0.0, 2.5)], "fov string, feature_id long, z double, y double, x double")
    out = traces.physical_coords(f, ticks).orderBy("feature_id").collect()
    assert (out[0].xc, out[0].yc, out[0].zc) == (14.0, 11.0, 5.0) and out[1].xc is None


@pytest.mark.parametrize(("jitter", "drop", "errors"), [(0.0, False, 0), (0.8, False, 0), (0.0, True, 1)])
def test_exhaustive_decoder_recovers_planted_codes(spark, jitter, drop, errors):
    import random

    r = random.Random(3)
    book = codes(spark, *((f"T{k}", [1.0 if (k + i * (k % 3 + 1)) % 5 == c else 0.0 for i in range(4) for c in range(5)]) for k in range(5)))
    rows, n = [], 0
    for k in range(5):
        for i in range(4):
            if not (drop and i == k % 4):
                rows.append(("f", i, (k + i * (k % 3 + 1)) % 5, n, 0.0, 40.0 * k + r.uniform(-jitter, jitter), 30.0 + r.uniform(-jitter, jitter), 1.0))
                n += 1
    s = spark.createDataFrame(rows, "fov string, r int, c int, spot_id long, z double, y double, x double, intensity double")
    for mode in ("high", "med", "low"):
        out = check_all.check_all(s, book, 4, 5, 3, errors, mode).collect()
        assert sorted(o.target for o in out) == [f"T{k}" for k in range(5)]
        assert {o.rounds_used for o in out} == {3 if drop else 4}
    assert check_all.check_all(s, book, 4, 5, 3, errors, "low", (1.0, 0.5, 0.5)).count() == 5


def test_composite_codebook(spark):
    book = codebook.from_code_array(spark, [{"codeword": [{"r": 0, "c": 0, "v": 1}, {"r": 1, "c": 1, "v": 1}], "target": "A"}, {"codeword": [{"r": 0, "c": 1, "v": 1}, {"r": 1, "c": 0, "v": 1}], "target": "B"}, {"codeword": [{"r": 2, "c": 0, "v": 1}], "target": "C"}, {"codeword": [{"r": 2, "c": 1, "v": 1}], "target": "D"}])
    first = codebook.to_codes(select.codebook_partial(book, {"r": (0, 1)}), 2, 2)
    assert {r.target for r in first.collect()} == {"A", "B"}
    s = spark.createDataFrame([("f", 2, 0, 1), ("f", 2, 1, 2), ("f", 2, 7, 3)], "fov string, r int, c int, spot_id long")
    assert [r.target for r in decode.simple_lookup(s, book.where("r = 2")).orderBy("spot_id").collect()] == ["C", "D", None]


def test_traces_of_another_size_are_refused(spark):
    for f in (lambda d: decode.decode_metric(d, codes(spark, ("A", A)), 4, 1, 0), lambda d: decode.decode_per_round_max(d, codes(spark, ("A", A)), 2, 2)):
        with pytest.raises(Exception, match="traces must have 4 values"):
            f(features(spark, [1, 2, 3])).collect()
    assert traces.zeros(features(spark, [1]), 2, 2).first().trace == [0.0] * 4


def test_synthetic_intensities_decode_to_what_they_are(spark):
    from lumatile.sources import tables

    book = codebook.to_codes(codebook.synthetic_one_hot(spark, 3, 3, 6), 3, 3)
    f = tables.synthetic_intensities(spark, book, 60, seed=4)
    assert f.collect() == tables.synthetic_intensities(spark, book, 60, seed=4).repartition(3).orderBy("feature_id").collect()
    out = decode.decode_metric(f.withColumnRenamed("target", "planted"), book, 9, 0.5, 0.1).collect()
    assert all(r.target == r.planted and r.passes_thresholds for r in out)
