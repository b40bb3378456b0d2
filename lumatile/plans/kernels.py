"""Registered queries with image kernels, documents and pipelines. Linear and rank kernels have SQL oracles that sum over neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import check_all, find_spots, masks, pixel_decode, pixel_filters, registration, segment, select, tile_filters
from ..operators.tiles import to_pixels, to_tiles
from ..sources import codebook, experiment, projections as P, tables, validate
from ..sources.projections import with_
from . import pipelines
from .relational import _LONG, _TILES, PX, _ctes, _tiles, clipped, query, r6

K = "fov, r, c, z, y, x"


def _at(v: str, mode: str) -> str:
    return {"nearest": f"least(15, greatest(0, {v}))", "reflect": f"CASE WHEN {v} < 0 THEN -1 - ({v}) WHEN {v} > 15 THEN 31 - ({v}) ELSE {v} END", "constant": v}[mode]


def _conv(src: str, axis: str, weights: str, mode: str) -> str:
    """SQL: src convolved along y or x with a table of (d, k)."""
    other = "x" if axis == "y" else "y"
    return f"SELECT o.fov, o.r, o.c, o.z, o.y, o.x, sum(k * p.value) AS value FROM {src} o CROSS JOIN {weights} JOIN {src} p ON p.fov = o.fov AND p.r = o.r AND p.c = o.c AND p.z = o.z AND p.{other} = o.{other} AND p.{axis} = {_at(f'o.{axis} + d', mode)} GROUP BY o.fov, o.r, o.c, o.z, o.y, o.x"


def _gauss(sigma: float, second: bool = False) -> str:
    reach = int(4 * sigma + 0.5)
    k = f"exp(-0.5 * (d / {sigma}::DOUBLE) ** 2) / sum(exp(-0.5 * (d / {sigma}::DOUBLE) ** 2)) OVER ()"
    return f"SELECT d, {k}" + (f" * (d * d / {sigma**4!r}::DOUBLE - 1 / {sigma**2!r}::DOUBLE)" if second else "") + f" AS k FROM range({-reach}, {reach + 1}) t(d)"


def _box(n: int) -> str:
    return f"SELECT d, 1.0::DOUBLE / {n} AS k FROM range({-(n // 2)}, {n - n // 2}) t(d)"


def _planes(spark, sf) -> DataFrame:
    return to_tiles(P.pixels(spark, sf), "double")


_SMOOTH = {"pixels": P.SQL["pixels"], "w": _gauss(1.5), "gy": _conv("pixels", "y", "w", "nearest"), "g": _conv("gy", "x", "w", "nearest")}


@query(_ctes(**_SMOOTH) + f"SELECT {PX}, {clipped('value')} AS value FROM g")
def f8_gaussian_low_pass(spark, sf):
    return r6(to_pixels(tile_filters.gaussian_low_pass(_planes(spark, sf), 1.5)))


@query(_ctes(**_SMOOTH) + f"SELECT {PX}, {clipped('p.value - least(1, greatest(0, g.value))')} AS value FROM pixels p JOIN g USING ({K})")
def f7_gaussian_high_pass(spark, sf):
    return r6(to_pixels(tile_filters.gaussian_high_pass(_planes(spark, sf), 1.5)))


@query(_ctes(pixels=P.SQL["pixels"], w=_gauss(1.2), w2=_gauss(1.2, True), ay=_conv("pixels", "y", "w2", "reflect"), a=_conv("ay", "x", "w", "reflect"), vy=_conv("pixels", "y", "w", "reflect"), b=_conv("vy", "x", "w2", "reflect")) + f"SELECT {PX}, {clipped('-(a.value + b.value)')} AS value FROM a JOIN b USING ({K})")
def f9_laplace(spark, sf):
    return r6(to_pixels(tile_filters.laplace(_planes(spark, sf), 1.2)))


@query(_ctes(pixels=P.SQL["pixels"], w=_box(3), my=_conv("pixels", "y", "w", "reflect"), m=_conv("my", "x", "w", "reflect")) + f"SELECT {PX}, {clipped('p.value - m.value')} AS value FROM pixels p JOIN m USING ({K})")
def f12_mean_high_pass(spark, sf):
    return r6(to_pixels(tile_filters.mean_high_pass(_planes(spark, sf), 3)))


@query(_ctes(pixels=P.SQL["pixels"], w=_gauss(1.0), ly=_conv("pixels", "y", "w", "constant"), l=_conv("ly", "x", "w", "constant"), b=_box(5), my=_conv("pixels", "y", "b", "nearest"), m=_conv("my", "x", "b", "nearest")) + f"SELECT {PX}, CASE WHEN l.value - m.value >= 0.01 THEN {clipped('l.value - m.value')} ELSE 0.0 END AS value FROM l JOIN m USING ({K})")
def f1_bandpass(spark, sf):
    return r6(to_pixels(tile_filters.bandpass(_planes(spark, sf), 1.0, 5, 0.01)))


def _disk(src: str, pick: str, radius: int = 2) -> str:
    return f"SELECT o.fov, o.r, o.c, o.z, o.y, o.x, {pick}(p.value) AS value FROM {src} o CROSS JOIN (SELECT dy, dx FROM range({-radius}, {radius + 1}) a(dy), range({-radius}, {radius + 1}) b(dx) WHERE dy * dy + dx * dx <= {radius**2}) JOIN {src} p ON p.fov = o.fov AND p.r = o.r AND p.c = o.c AND p.z = o.z AND p.y = {_at('o.y + dy', 'reflect')} AND p.x = {_at('o.x + dx', 'reflect')} GROUP BY o.fov, o.r, o.c, o.z, o.y, o.x"


@query(_ctes(pixels=P.SQL["pixels"], e=_disk("pixels", "min"), o=_disk("e", "max")) + f"SELECT {PX}, {clipped('p.value - o.value')} AS value FROM pixels p JOIN o USING ({K})")
def f14_white_tophat(spark, sf):
    return r6(to_pixels(tile_filters.white_tophat(_planes(spark, sf), 2)))


def _richardson_lucy(rounds: int) -> dict[str, str]:
    """Tables e0 to e<rounds>: estimates by rounds of two convolutions, from an even image of 0.5."""
    out = {"pixels": P.SQL["pixels"], "w": "SELECT d, exp(-0.5::DOUBLE * d * d) / sum(exp(-0.5::DOUBLE * d * d)) OVER () AS k FROM range(-2, 3) t(d)", "e0": "SELECT * REPLACE (0.5::DOUBLE AS value) FROM pixels"}
    for n in range(1, rounds + 1):
        out |= {f"by{n}": _conv(f"e{n - 1}", "y", "w", "constant"), f"b{n}": _conv(f"by{n}", "x", "w", "constant")}
        out |= {f"q{n}": f"SELECT {PX}, p.value / b.value + 2.220446049250313e-16::DOUBLE AS value FROM pixels p JOIN b{n} b USING ({K})", f"cy{n}": _conv(f"q{n}", "y", "w", "constant"), f"c{n}": _conv(f"cy{n}", "x", "w", "constant")}
        out[f"e{n}"] = f"SELECT {PX}, e.value * c.value AS value FROM e{n - 1} e JOIN c{n} c USING ({K})"
    return out


@query(_ctes(**_richardson_lucy(3)) + f"SELECT {PX}, {clipped('value')} AS value FROM e3")
def f13_deconvolve_psf(spark, sf):
    return r6(to_pixels(tile_filters.deconvolve_psf(_planes(spark, sf), 3, 1.0)))


# --- registration -------------------------------------------------------------------------------


@query(with_("pixels") + "SELECT a.fov, a.r, a.c, a.z, a.y, a.x, round(coalesce(b.value, 0), 6) + 0.0 AS value FROM pixels a LEFT JOIN pixels b ON a.fov = b.fov AND a.r = b.r AND a.c = b.c AND a.z = b.z AND b.y = a.y + (a.r - 1) AND b.x = a.x + 2 * a.r")
def reg2_apply_warp(spark, sf):
    r = F.col("r").cast("double")
    matrix = F.array(F.lit(1.0), F.lit(0.0), 2 * r, F.lit(0.0), F.lit(1.0), r - 1, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    null = F.lit(None).cast("int")
    by_round = P.pixels(spark, sf).select("fov", "r").distinct()
    return r6(to_pixels(registration.apply_warp(_planes(spark, sf), by_round.select("fov", "r", null.alias("c"), null.alias("z"), F.lit("similarity").alias("type"), matrix.alias("matrix")))))


@query(with_("pixels") + "SELECT fov, r::INT AS r, (2 * r)::DOUBLE AS dx, (r + n % 4)::DOUBLE AS dy FROM (SELECT fov, length(fov) + substr(fov, 3)::INT AS n FROM pixels GROUP BY fov), range(4) t(r)")
def reg1_learn_translation(spark, sf):
    """Planes rolled by 2r to the right and, field by field otherwise, down are found to be."""
    ref = select.sel(P.pixels(spark, sf), {"r": 0, "c": 0, "z": 0})
    n = (F.length("fov") + F.substring("fov", 3, 9).cast("int")) % 4
    moved = ref.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("fov", F.col("k").alias("r"), "c", "z", ((F.col("y") + F.col("k") + n) % 16).cast("int").alias("y"), ((F.col("x") + 2 * F.col("k")) % 16).cast("int").alias("x"), "value")
    t = registration.learn_translation(to_tiles(moved, "double"), to_tiles(ref, "double"), "r")
    return r6(t.select("fov", "r", F.col("matrix")[2].alias("dx"), F.col("matrix")[5].alias("dy")))


# --- masks --------------------------------------------------------------------------------------

_BINARY = "SELECT fov, z, y, x FROM pixels WHERE r = 1 AND c = 2 AND value >= 0.55"
_REACH = """reach AS (SELECT fov, z, y, x, (z * 16 + y) * 16 + x AS n FROM b UNION SELECT b.fov, b.z, b.y, b.x, reach.n FROM reach JOIN b ON b.fov = reach.fov AND {}),
 low AS (SELECT fov, z, y, x, min(n) AS n FROM reach GROUP BY fov, z, y, x)"""
_RECURSIVE = "WITH RECURSIVE pixels AS (" + P.SQL["pixels"] + f"), b AS ({_BINARY}), "


@query(_RECURSIVE + _REACH.format("abs(b.z - reach.z) + abs(b.y - reach.y) + abs(b.x - reach.x) = 1") + " SELECT fov, (dense_rank() OVER (PARTITION BY fov ORDER BY n) - 1)::INT AS mask_id, z, y, x FROM low")
def mo2_structural_label(spark, sf):
    return segment.structural_label(pixel_filters.threshold_binarize(select.sel(P.pixels(spark, sf), {"r": 1, "c": 2}), 0.55))


def _coded(spark, sf) -> DataFrame:
    return select.sel(P.pixels(spark, sf), {"r": 1, "c": 2}).where("value >= 0.55").select("fov", "z", "y", "x", F.lit(1).alias("code"))


_PX2 = _RECURSIVE + _REACH.format("abs(b.z - reach.z) <= 1 AND abs(b.y - reach.y) <= 1 AND abs(b.x - reach.x) <= 1 AND abs(b.z - reach.z) + abs(b.y - reach.y) + abs(b.x - reach.x) BETWEEN 1 AND 2") + " SELECT fov, z, y, x, dense_rank() OVER (PARTITION BY fov ORDER BY n)::INT AS label FROM low"


@query(_PX2)
def px2_components(spark, sf):
    return pixel_decode.label_components(_coded(spark, sf)).select("fov", "z", "y", "x", "label")


@query(_PX2)
def px2_components_distributed(spark, sf):
    return pixel_decode.label_components_sql(_coded(spark, sf)).select("fov", "z", "y", "x", "label")


@query()
def mo3_min_distance_label(spark, sf):
    return segment.min_distance_label(masks.reduce_masks(P.masks(spark, sf)), 3)


@query()
def mo8_watershed(spark, sf):
    px = select.sel(P.pixels(spark, sf), {"r": 0, "c": 0})
    markers = segment.structural_label(pixel_filters.threshold_binarize(px, 0.7))
    return segment.watershed_segment(px, markers, pixel_filters.threshold_binarize(px, 0.2))


@query()
def mo9_watershed_cells(spark, sf):
    px = P.pixels(spark, sf)
    return segment.watershed_cells(px, select.sel(px, {"r": 0}), 0.75, 0.6, 1, (2, 10_000))


@query(with_("mask_pixels") + "SELECT fov, mask_id, z, (63 - y)::INT AS y, x FROM mask_pixels")
def mo5_map_masks(spark, sf):
    return segment.map_masks(P.masks(spark, sf), lambda a: a[:, ::-1], (1, 64, 64))


@query("SELECT 'fov_' || (p_partkey // 30) AS fov, p_partkey::INT AS mask_id, 0 AS z, y::INT AS y, x::INT AS x FROM (SELECT p_partkey, p_partkey % 8 AS a, p_size % 6 + 1 AS n FROM part), range(0, 20) q(y), range(0, 20) w(x) WHERE y BETWEEN a AND a + n AND x BETWEEN 2 AND 2 + n")
def src16_roi_masks(spark, sf):
    p = P.table(spark, sf, "part")
    y0, n = F.col("p_partkey") % 8, F.col("p_size") % 6 + 1
    d = lambda *v: F.array(*(x.cast("double") for x in v))
    rois = p.select(F.concat(F.lit("fov_"), F.floor(F.col("p_partkey") / 30).cast("string")).alias("fov"), F.col("p_partkey").cast("int").alias("mask_id"), d(y0, y0 + n, y0 + n, y0).alias("y"), d(F.lit(2), F.lit(2), 2 + n, 2 + n).alias("x"))
    return segment.from_rois(rois, 20, 20)


# --- pixel decoding -----------------------------------------------------------------------------

_DEC = "SELECT fov, feature_id, feature_id // 256 AS z, feature_id // 16 % 16 AS y, feature_id % 16 AS x, CASE WHEN v < 0.9 THEN 'T' || (floor(v * 5)::INT) END AS target, v AS distance, v >= 0.2 AS passes_thresholds FROM (SELECT fov, (z * 16 + y) * 16 + x AS feature_id, avg(value) AS v FROM pixels WHERE r = 0 GROUP BY fov, z, y, x)"


def _decoded_pixels(spark, sf) -> DataFrame:
    px = P.pixels(spark, sf).where("r = 0")
    v = px.groupBy("fov", "z", "y", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "value"))), lambda s: s["value"]).alias("trace"))
    v = v.withColumn("distance", F.aggregate("trace", F.lit(0.0), lambda s, x: s + x) / F.size("trace"))  # in order of c: means at a threshold hang on it
    return v.select("fov", ((F.col("z") * 16 + F.col("y")) * 16 + F.col("x")).cast("long").alias("feature_id"), "z", "y", "x", "trace", F.when(F.col("distance") < 0.9, F.concat(F.lit("T"), F.floor(F.col("distance") * 5).cast("string"))).alias("target"), "distance", (F.col("distance") >= 0.2).alias("passes_thresholds"))


@query(with_("pixels", d=_DEC) + "SELECT target, row_number() OVER (ORDER BY target)::INT AS code FROM (SELECT DISTINCT target FROM d WHERE target IS NOT NULL)")
def px3_targets_map(spark, sf):
    return pixel_decode.targets_map(_decoded_pixels(spark, sf))


_CODED = with_("pixels", d=_DEC, m="SELECT target, row_number() OVER (ORDER BY target) AS code FROM (SELECT DISTINCT target FROM d WHERE target IS NOT NULL)", i="SELECT fov, z, y, x, CASE WHEN passes_thresholds THEN coalesce(code, 0) ELSE 0 END::INT AS code FROM d LEFT JOIN m USING (target)")


@query(_CODED + "SELECT fov, z::INT AS z, y::INT AS y, x::INT AS x, code FROM i")
def px4_decoded_image(spark, sf):
    d = _decoded_pixels(spark, sf)
    return pixel_decode.decoded_image(d, pixel_decode.targets_map(d))


_LABEL = "SELECT fov, z, y, x, code, (y // 4 * 4 + x // 4 + 1)::INT AS label FROM i WHERE code > 0"


def _blocks(image: DataFrame) -> DataFrame:
    return image.where("code > 0").withColumn("label", (F.floor(F.col("y") / 4) * 4 + F.floor(F.col("x") / 4) + 1).cast("int"))


@query(_CODED.rstrip() + f",\n l AS ({_LABEL}) SELECT fov, label, round(avg(d.distance), 6) AS distance, [" + ", ".join(f"round(avg(p.value) FILTER (p.c = {c}), 6) + 0.0" for c in range(3)) + "] AS trace FROM l JOIN d USING (fov, z, y, x) JOIN pixels p USING (fov, z, y, x) WHERE p.r = 0 GROUP BY fov, label")
def px5_mean_trace(spark, sf):
    d = _decoded_pixels(spark, sf)
    return r6(pixel_decode.mean_pixel_traces(d, _blocks(pixel_decode.decoded_image(d, pixel_decode.targets_map(d)))))


@query(_CODED.rstrip() + f""",\n l AS ({_LABEL}), b AS (SELECT fov, label, count(*) AS area, floor(avg(z))::INT AS z, floor(avg(y))::INT AS y, floor(avg(x))::INT AS x, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM l GROUP BY fov, label),
 h AS (SELECT b.fov, label, i.code, count(*) AS n FROM b JOIN i ON i.fov = b.fov AND i.code > 0 AND i.z BETWEEN z0 AND z1 AND i.y BETWEEN y0 AND y1 AND i.x BETWEEN x0 AND x1 GROUP BY ALL), t AS (SELECT fov, label, arg_min(code, (-n, code)) AS code FROM h GROUP BY ALL)
 SELECT fov, label, area, z, y, x, round(CASE WHEN z0 = z1 THEN sqrt(4 * area / pi()) ELSE cbrt(6 * area / pi()) END / 2, 6) AS radius, target, area >= 3 AND area < 20 AS passes_thresholds FROM b JOIN t USING (fov, label) JOIN m USING (code)""")
def px6_attributes(spark, sf):
    d = _decoded_pixels(spark, sf)
    codes = pixel_decode.targets_map(d)
    image = pixel_decode.decoded_image(d, codes)
    out = pixel_decode.component_attributes(_blocks(image), image, codes, 3, 20)
    return r6(out.select("fov", "label", "area", "z", "y", "x", "radius", "target", "passes_thresholds"))


def _pixel_codes(spark, n: int = 12) -> DataFrame:
    return codebook.to_codes(codebook.synthetic_one_hot(spark, 4, 3, n, seed=3), 4, 3)


@query()
def px1_pixel_spot_decoder(spark, sf):
    return r6(pixel_decode.pixel_spot_decoder(P.pixels(spark, sf), _pixel_codes(spark), 12, "euclidean", 0.9, 0.5, 1, 50))


@query()
def px7_combine_adjacent(spark, sf):
    return r6(pixel_decode.combine_adjacent_features(_decoded_pixels(spark, sf), 1, 50))


# --- spot finders and exhaustive decoding -------------------------------------------------------


@query()
def fs1_blob_log(spark, sf):
    return r6(find_spots.blob_detector(_planes(spark, sf), 1, 2, 3, 0.05))


@query()
def fs1_blob_dog_reference(spark, sf):
    t = _planes(spark, sf)
    return r6(find_spots.blob_detector(t, 1, 2, 3, 0.02, detector_method="blob_dog", reference=find_spots.projection(t, "mean")))


@query()
def fs1_blob_doh(spark, sf):
    return r6(find_spots.blob_detector(_planes(spark, sf), 1, 2, 3, 0.0001, is_volume=False, detector_method="blob_doh"))


@query()
def fs2_local_max(spark, sf):
    return r6(find_spots.local_max_peak_finder(_planes(spark, sf), 2, 0, 1, 500))


@query()
def fs3_trackpy(spark, sf):
    return r6(find_spots.trackpy_local_max_peak_finder(_planes(spark, sf), (1, 3, 3), 0.1, 10, 3, percentile=50))


_GRID = "SELECT 'fov_' || (vec_id // 256) AS fov, vec_id, label, (vec_id % 256 // 16) * 20.0 AS y, (vec_id % 16) * 20.0 AS x FROM embeddings"


def _barcodes(spark, sf) -> DataFrame:
    """A spot of each round of a barcode at every place of the grid."""
    at = P.table(spark, sf, "embeddings").select(F.concat(F.lit("fov_"), F.floor(F.col("vec_id") / 256).cast("string")).alias("fov"), "vec_id", "label", (F.floor(F.col("vec_id") % 256 / 16) * 20.0).alias("y"), (F.col("vec_id") % 16 * 20.0).alias("x"))
    spots = at.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return spots.select("fov", "r", ((F.col("label") + F.col("r") * (1 + F.floor(F.col("label") / 5))) % 5).cast("int").alias("c"), (F.col("vec_id") * 8 + F.col("r")).alias("spot_id"), F.lit(0.0).alias("z"), "y", "x", F.lit(1.0).alias("intensity"), "vec_id")


def _barcode_codes(spark) -> DataFrame:
    code = lambda k: [1.0 if (k + r * (1 + k // 5)) % 5 == c else 0.0 for r in range(4) for c in range(5)]
    return spark.createDataFrame([(k, f"G{k}", code(k)) for k in range(10)], "code_idx int, target string, trace array<double>")


_CALLED = ("fov", "target", "y", "x", "rounds_used")


@query(f"SELECT fov, 'G' || label AS target, y::DOUBLE AS y, x::DOUBLE AS x, 4 AS rounds_used FROM ({_GRID})")
def dec8_check_all(spark, sf):
    """Planted barcodes, far apart: all come back at their places."""
    return r6(check_all.check_all(_barcodes(spark, sf).drop("vec_id"), _barcode_codes(spark), 4, 5, 2.0).select(*_CALLED))


@query(f"SELECT fov, 'G' || label AS target, y::DOUBLE AS y, x::DOUBLE AS x, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 4 END AS rounds_used FROM ({_GRID})")
def dec8_missing_round(spark, sf):
    """Every third barcode lacks a round, the fourth, third, second or first; with one round of error all come back."""
    spots = _barcodes(spark, sf).where((F.col("vec_id") % 3 != 0) | (F.col("r") != F.floor(F.col("vec_id") / 3) % 4)).drop("vec_id")
    return r6(check_all.check_all(spots, _barcode_codes(spark), 4, 5, 2.0, error_rounds=1).select(*_CALLED))


# --- documents ----------------------------------------------------------------------------------

_LONG_CODES = "SELECT code_idx, target, ((i - 1) // 4)::INT AS r, ((i - 1) % 4)::INT AS c, round(trace[i], 6) AS v FROM codes, range(1, 9) t(i) WHERE trace[i] <> 0"


def _long_codes(spark, sf) -> DataFrame:
    return P.codes(spark, sf).select("code_idx", "target", F.posexplode("trace").alias("i", "v")).select("code_idx", "target", F.floor(F.col("i") / 4).cast("int").alias("r"), (F.col("i") % 4).cast("int").alias("c"), F.col("v"))


@query(with_("codes") + _LONG_CODES)
def snk6_codebook_roundtrip(spark, sf):
    back = codebook.read_documents(codebook.to_documents(_long_codes(spark, sf)))
    return r6(back.select("code_idx", "target", "r", "c", "v"))


@query("SELECT event_id, 'e' || event_type AS target, (event_id % 4)::INT AS c, 0 AS r, round(json_extract(props, '$.k')::DOUBLE / 100, 6) AS v FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND event_id % 11 > 0")
def src2_codebook_json(spark, sf):
    e = P.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 11 == 0, F.lit("{")).otherwise(F.concat(F.lit('{"version":"0.0.0","mappings":[{"target":"e'), "event_type", F.lit('","codeword":[{"c":'), (F.col("event_id") % 4).cast("string"), F.lit(',"v":'), (k.cast("double") / 100).cast("string"), F.lit("}]}]}")))
    docs = e.where(k.isNotNull()).select("event_id", text.alias("value"))
    return r6(codebook.read_documents(docs).select("event_id", "target", "c", "r", "v"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'version' WHEN 2 THEN 'mappings' WHEN 3 THEN 'entry' END AS problem FROM events")
def x2_validate(spark, sf):
    e = P.table(spark, sf, "events")
    good = '{"version":"0.0.0","mappings":[{"target":"A","codeword":[{"r":0,"c":1,"v":1}]}]}'
    texts = ["{nonsense", good.replace('"0.0.0"', '"x"'), '{"version":"0.0.0","mappings":[]}', good.replace('"v":1', '"v":7'), good]
    value = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 5 + 1).cast("int"))
    return validate.codebook_problems(e.select("event_id", value.alias("value"))).select("event_id", "problem")


_NAMES = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'junk' || o_orderkey || '.tiff' ELSE 'img-f' || (o_custkey % 10) || '-r' || (o_orderkey % 4) || '-c' || (o_orderkey % 3) || '-z' || (o_orderkey % 7) || '.tiff' END AS name FROM orders"


@query(f"SELECT o_orderkey, 'img' AS prefix, regexp_extract(name, 'f([0-9]+)-', 1)::INT AS f, regexp_extract(name, '-r([0-9]+)', 1)::INT AS r, regexp_extract(name, '-c([0-9]+)', 1)::INT AS c, regexp_extract(name, '-z([0-9]+)', 1)::INT AS z, 'tiff' AS ext FROM ({_NAMES}) WHERE name NOT LIKE 'junk%'")
def src11_filename_parse(spark, sf):
    o = P.table(spark, sf, "orders")
    part = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    name = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("junk"), F.col("o_orderkey").cast("string"), F.lit(".tiff"))).otherwise(F.concat(part("img-f", "o_custkey", 10), part("-r", "o_orderkey", 4), part("-c", "o_orderkey", 3), part("-z", "o_orderkey", 7), F.lit(".tiff")))
    return experiment.parse_names(o.select("o_orderkey", name.alias("name"))).drop("name")


def _index(spark, sf) -> DataFrame:
    t = _tiles(spark, sf)
    return t.select("fov", F.lit("primary").alias("image_type"), "r", "c", "z", F.lit(4).alias("height"), F.lit(5).alias("width"), F.concat_ws("-", F.lit("/d/t"), "fov", "r", "c", "z").alias("file"), F.lit("RAW").alias("tile_format"), F.lit("00").alias("sha256"), F.col("xmin").alias("xc_min"), F.col("xmax").alias("xc_max"), F.col("ymin").alias("yc_min"), F.col("ymax").alias("yc_max"), F.col("z").cast("double").alias("zc_min"), (F.col("z") + 1).cast("double").alias("zc_max"))


@query(with_(t=_TILES) + "SELECT fov, r, c, z, 4 AS height, 5 AS width, '/d/t-' || fov || '-' || r || '-' || c || '-' || z AS file, xmin AS xc_min, xmax AS xc_max, ymin AS yc_min, ymax AS yc_max, z::DOUBLE AS zc_min, (z + 1)::DOUBLE AS zc_max FROM t")
def snk9_manifest_roundtrip(spark, sf):
    docs = experiment.fov_documents(_index(spark, sf).withColumn("file", F.regexp_replace("file", "^/d/", "")), experiment.DOCUMENT_TILES).withColumn("path", F.lit("/d/x.json"))
    return experiment.read_fov_documents(docs).select("fov", "r", "c", "z", "height", "width", "file", *(f"{a}_{m}" for a in ("xc", "yc", "zc") for m in ("min", "max")))


@query(with_(t="SELECT DISTINCT fov, z FROM (" + _TILES + ")") + "SELECT fov, 'z' AS axis, z AS idx, z + 0.5::DOUBLE AS phys FROM t UNION ALL SELECT fov, 'y', i::INT, 1.0::DOUBLE + i * 8.0 / 3 FROM (SELECT DISTINCT fov FROM t), range(4) r(i)")
def src10_axis_ticks(spark, sf):
    index = _index(spark, sf).withColumns({"yc_min": F.lit(1.0), "yc_max": F.lit(9.0)})
    return experiment.axis_ticks(index).where("axis <> 'x'")


@query(with_("spots") + "SELECT x, y, 'T' || c AS target, 'T' || c AS target_2 FROM (SELECT round(x, 6) AS x, y, c FROM spots)")
def snk4_mermaid(spark, sf):
    return tables.mermaid(r6(P.spots(spark, sf)).withColumn("target", F.concat(F.lit("T"), F.col("c").cast("string"))))


@query(with_("spots") + "SELECT '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || floor(x)::DOUBLE || ',' || y || ']},\"properties\":{\"radius\":1.0}}' AS value FROM spots")
def snk7_geojson(spark, sf):
    return tables.geojson(P.spots(spark, sf).withColumn("x", F.floor("x").cast("double")))


@query(with_("codes", l=_LONG) + "SELECT code_idx, target, list(round(v, 6) + 0.0 ORDER BY r, c) AS trace FROM l GROUP BY code_idx, target")
def src3_codebook_to_codes(spark, sf):
    return r6(codebook.to_codes(_long_codes(spark, sf), 2, 4))


# --- pipelines ----------------------------------------------------------------------------------


def _scene(spark, sf):
    codes = codebook.to_codes(codebook.synthetic_one_hot(spark, 3, 3, 8, seed=1), 3, 3)
    spots = tables.synthetic_spots(spark, codes, 3, 3, 12, 40, 40, 1, seed=5)
    return codes, tables.synthetic_tiles(spots, 3, 3, 1, 40, 40, (0.0, 1.5, 1.5), seed=2)


@query()
def plan_spot_pipeline(spark, sf):
    codes, tiles = _scene(spark, sf)
    return r6(pipelines.spot_pipeline(tiles, codes, 3, 3).select("fov", "y", "x", "target", "distance", "passes_thresholds"))


@query()
def plan_pixel_pipeline(spark, sf):
    codes, tiles = _scene(spark, sf)
    return r6(pipelines.pixel_pipeline(tiles, codes, 9).select("fov", "y", "x", "area", "target", "passes_thresholds"))
