"""Documents, codebooks, tables, streaming."""

import copy
import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatile import cli
from lumatile.operators import select
from lumatile.sources import codebook, datasource, experiment, mask_archive, projections, tables, tiff, validate
from lumatile.streaming import fields


def write(path, doc):
    path.write_text(json.dumps(doc))


@pytest.fixture
def folder(tmp_path):
    word = [{"codeword": [{"r": 0, "c": 0, "v": 1}], "target": "A"}, {"codeword": [{"r": 0, "c": 1, "v": 0.5}], "target": "B"}]
    write(tmp_path / "codebook.json", {"version": "0.0.0", "mappings": word})
    write(tmp_path / "experiment.json", {"version": "5.0.0", "images": {"primary": "primary.json", "nuclei": "nuclei.json"}, "codebook": "codebook.json", "extras": {"k": 1}})
    for kind in ("primary", "nuclei"):
        write(tmp_path / f"{kind}.json", {"version": "0.1.0", "contents": {"fov_0": f"{kind}-0.json"}})
        tiles = []
        for r in (0, 1):
            name = f"{kind}-{r}.npy"
            np.save(tmp_path / name, np.full((3, 4), 50 * r, np.uint8))
            tiles.append({"coordinates": {"xc": [0, 3], "yc": [0.0, 1.0], "zc": 2.5}, "indices": {"r": r, "c": 0, "z": 0}, "file": name, "sha256": "0"})
        write(tmp_path / f"{kind}-0.json", {"version": "0.1.0", "dimensions": ["x", "y", "z", "r", "c"], "shape": {"r": 2, "c": 1, "z": 1}, "default_tile_format": "NUMPY", "default_tile_shape": {"x": 4, "y": 3}, "tiles": tiles})
    return tmp_path


def test_experiment_is_read(spark, folder):
    index, book, extras = experiment.from_json(spark, f"{folder}/experiment.json", strict=True)
    assert extras == {"k": 1} and book.count() == 2 and index.count() == 4
    first = index.where("image_type = 'primary'").orderBy("r").first()
    assert (first.xc_min, first.xc_max, first.zc_min, first.zc_max, first.height, first.width) == (0, 3, 2.5, 2.5, 3, 4)
    tiles = experiment.load_tiles(index.where("image_type = 'primary'")).orderBy("r").collect()
    assert tiles[1].pixels == pytest.approx([50 / 255] * 12)
    ticks = experiment.axis_ticks(index.where("image_type = 'primary'"))
    assert [r.phys for r in ticks.where("axis = 'x'").orderBy("idx").collect()] == [0, 1, 2, 3]


def test_experiment_is_written(spark, folder, tmp_path):
    index, book, _ = experiment.from_json(spark, f"{folder}/experiment.json")
    out = tmp_path / "out"
    out.mkdir()
    experiment.write_experiment(index.withColumn("file", F.regexp_replace("file", ".*/", "../")), book, str(out), {"a": 2})
    again, book2, extras = experiment.from_json(spark, f"{out}/experiment.json", strict=True)
    assert extras == {"a": 2} and again.count() == 4 and sorted(map(tuple, book2.collect())) == sorted(map(tuple, book.collect()))


def test_old_experiments_and_missing_primary():
    assert experiment.images_of({"version": "4.0.0", "primary_images": "p", "auxiliary_images": {"n": "q"}}) == {"primary": "p", "n": "q"}
    with pytest.raises(ValueError):
        experiment.images_of({"version": "5.0.0", "images": {"nuclei": "n"}})


GOOD = {
    "experiment": {"version": "5.0.0", "images": {"primary": "p.json"}, "codebook": "c.json", "extras": {}},
    "manifest": {"version": "0.1.0", "contents": {"f": "x.json"}},
    "fov": {"version": "0.1.0", "dimensions": ["x"], "shape": {"r": 1}, "tiles": [{"coordinates": {"xc": 1, "yc": 1}, "indices": {"r": 0, "c": 0}, "file": "a"}]},
    "codebook": {"version": "0.0.0", "mappings": [{"target": "A", "codeword": [{"r": 0, "c": 0, "v": 1}]}]},
}


@pytest.mark.parametrize("kind", GOOD)
def test_validation_and_mutations(kind):
    check = validate.RULES[kind]
    assert check(GOOD[kind]) == []
    assert check([]) and check({})
    for key in GOOD[kind]:
        for wrong in (None, 7):
            bad = copy.deepcopy(GOOD[kind])
            if wrong is None:
                del bad[key]
            else:
                bad[key] = wrong
            if key != "extras" or wrong is None:
                assert check(bad), (key, wrong)


def test_codebook_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        codebook.from_code_array(spark, ["x"])
    with pytest.raises(ValueError):
        codebook.from_code_array(spark, [{"codeword": []}])
    with pytest.raises(KeyError):
        codebook.from_code_array(spark, [{"codeword": [{"r": 0}], "target": "A"}])
    with pytest.raises(KeyError):
        codebook.from_code_array(spark, [{"codeword": [{"c": 0}], "target": "A"}], strict_compat=True)
    with pytest.raises(ValueError):
        codebook.from_code_array(spark, [{"codeword": [{"r": 3, "c": 0, "v": 1}], "target": "A"}], n_round=2)
    assert codebook.from_code_array(spark, [{"codeword": [{"c": 0, "v": 0.75, "r": 0}], "target": "A"}], strict_compat=True).first().v == 0
    write(tmp_path / "list.json", [1])
    with pytest.raises(ValueError):
        codebook.open_json(spark, f"{tmp_path}/list.json")
    write(tmp_path / "new.json", {"version": "9.0.0", "mappings": []})
    with pytest.raises(ValueError):
        codebook.open_json(spark, f"{tmp_path}/new.json")


def test_one_hot_codebook(spark):
    book = codebook.synthetic_one_hot(spark, 2, 3, 9)
    codes = {tuple(r.trace) for r in codebook.to_codes(book, 2, 3).collect()}
    assert len(codes) == 9 and all(sum(c[:3]) == sum(c[3:]) == 1 for c in codes)
    with pytest.raises(ValueError):
        codebook.synthetic_one_hot(spark, 1, 2, 3)
    assert codebook.zeros(spark, ["a", "b"], 2, 3).agg(F.sum("v")).first()[0] == 0


def test_structured_names(spark):
    names = spark.createDataFrame([("im-f0-r1-c2-z3.tiff",), ("other.txt",)], "name string")
    coords = spark.createDataFrame([(0, 1, 2, 3, 0.0, 1.0), (0, 1, 2, 4, 0.0, 1.0)], "fov int, round int, ch int, zplane int, xc_min double, xc_max double")
    found, extra = experiment.structured_dataset(names, coords)
    assert found.count() == 1 and [r.z for r in extra.collect()] == [4]
    with pytest.raises(Exception, match="no coordinates"):
        experiment.structured_dataset(names, coords.where("zplane = 4"))[0].collect()


def test_stacks_from_arrays_and_functions(spark):
    with pytest.raises(ValueError):
        experiment.from_numpy(spark, np.zeros((2, 2)))
    with pytest.raises(ValueError):
        experiment.from_numpy(spark, np.full((1, 1, 1, 2, 2), 1.5))
    t = experiment.from_tilefetcher(spark, lambda fov, r, c, z: np.full((2, 3), r / 10), ["a", "b"], [1, 2, 4], [0], [0])
    assert t.count() == 6 and t.where("r = 4").first().pixels == pytest.approx([0.4] * 6)
    labelled = experiment.from_numpy(spark, np.zeros((2, 1, 1, 2, 2)), labels={"r": [3, 7]})
    assert {r.r for r in labelled.collect()} == {3, 7}


def test_crops():
    assert select.crop_bounds(-1, 5) == (4, 5) and select.crop_bounds((1, -1), 5) == (1, 4) and select.crop_bounds((2, 99), 5) == (2, 5)
    with pytest.raises(IndexError):
        select.crop_bounds(5, 5)


def test_tables_round_trip(spark, tmp_path):
    spots = spark.createDataFrame([("f", 1.0, 2.0, 0.0, 1.0, "A", 3.0, 4.0)], "fov string, x double, y double, z double, radius double, target string, xc double, yc double")
    tables.save_spots(spots, f"{tmp_path}/s")
    assert tables.load_spots(spark, f"{tmp_path}/s").first().x == 1
    tables.save_decoded_csv(spots, f"{tmp_path}/d")
    assert tables.load_decoded_csv(spark, f"{tmp_path}/d").first().target == "A"
    tables.save(spots, f"{tmp_path}/p", ("fov",))
    assert tables.load(spark, f"{tmp_path}/p", ("target",)).count() == 1
    with pytest.raises(ValueError):
        tables.save_spots(spots.drop("radius"), f"{tmp_path}/e")


def test_labels_and_masks(spark):
    a = np.array([[0, 1], [2, 2]])
    assert tables.from_label_array(spark, a).groupBy("label").count().orderBy("label").collect() == [(1, 1), (2, 2)]
    with pytest.raises(TypeError):
        tables.from_label_array(spark, a.astype(float))
    with pytest.raises(ValueError):
        tables.from_binary_arrays(spark, [np.ones((1, 2)), np.ones((2, 2))])


def test_log(spark):
    log = tables.Log()

    @tables.logged(log)
    def step(df, radius, mode="a"):
        return df

    step(spark.range(1), 3, mode="b")
    row = log.table(spark).first()
    assert row.method == "step" and json.loads(row.arguments)["radius"] == 3 and "spark" in log.environment()
    assert tables.settings(spark)["strict"] == "false"


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    f = projections.features(spark, sf).withColumn("ts", F.lit(datetime.datetime(2024, 1, 1)) + F.make_dt_interval(mins=(F.col("feature_id") % 60).cast("int")))
    f.repartition(4).write.parquet(f"{tmp_path}/in")
    codes = projections.codes(spark, sf)
    stream = fields.decode_stream(fields.read_stream(spark, f"{tmp_path}/in", f.schema, 1), codes, 2, 4)
    fields.run_to_table(stream.select("feature_id", "target", "ts"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    batch = fields.decode_stream(f, codes, 2, 4).select("feature_id", "target", "ts")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, batch.collect()))
    counts = fields.gene_counts(fields.decode_stream(fields.read_stream(spark, f"{tmp_path}/in", f.schema, 1), codes, 2, 4))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == batch.where("target IS NOT NULL").count()


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float32])
def test_tiff_pages(kind):
    pages = [(np.arange(12).reshape(3, 4) * (k + 1)).astype(kind) for k in range(3)]
    back = tiff.read_pages(tiff.write_pages(pages))
    assert len(back) == 3 and all((a == b).all() and a.dtype == b.dtype for a, b in zip(pages, back, strict=True))
    with pytest.raises(ValueError):
        tiff.read_pages(b"nothing")


def test_multipage_tiffs_are_in_order(spark):
    data = np.zeros((2, 2, 1, 2, 3), np.float32)
    data[:] = np.arange(4).reshape(2, 2, 1, 1, 1) / 4
    row = experiment.multipage_tiffs(experiment.from_numpy(spark, data)).first()
    assert [float(p[0, 0]) for p in tiff.read_pages(bytes(row.content))] == [0, 0.25, 0.5, 0.75]
    assert (experiment.decode_tile(bytes(row.content), "TIFF", 2, 3) == 0).all()


def test_cli(tmp_path, capsys):
    write(tmp_path / "good.json", GOOD["codebook"])
    (tmp_path / "bad.json").write_text("{")
    assert cli.main(["validate", "codebook", f"{tmp_path}/good.json"]) == 0
    assert cli.main(["validate", "codebook", f"{tmp_path}/good.json", f"{tmp_path}/bad.json"]) == 1
    assert cli.main(["version"]) == 0 and cli.main([]) == 2
    assert "not JSON" in capsys.readouterr().out


def test_tile_data_source(spark, tmp_path):
    def fetch(fov, r, c, z):
        (tmp_path / f"{fov}-{r}-{c}-{z}").touch()
        return np.full((2, 3), r / 10)

    datasource.register(spark, fetch)
    t = spark.read.format("tiles").options(fovs="a,b", rounds="0,1,2", chs="0,1", zplanes="0").load()
    out = t.where("fov = 'b' AND r IN (1, 2)").orderBy("r", "c").collect()
    assert [(x.fov, x.r, x.c) for x in out] == [("b", 1, 0), ("b", 1, 1), ("b", 2, 0), ("b", 2, 1)] and out[2].pixels == pytest.approx([0.2] * 6)
    assert len(list(tmp_path.iterdir())) == 12
    assert t.where("fov = 'none'").count() == 0 and t.count() == 12


def archive_of(masks, path):
    """A mask archive as another program writes it: pickles of a class that isn't there when they are read."""
    import io
    import pickle
    import sys
    import tarfile
    import types

    module = types.ModuleType("elsewhere")
    sys.modules["elsewhere"] = module
    kept = type("MaskOnDisk", (), {})
    kept.__module__, kept.__qualname__ = "elsewhere", "v0_0.MaskOnDisk"
    module.v0_0 = types.SimpleNamespace(MaskOnDisk=kept)
    with tarfile.open(path, "w:gz") as tar:
        for n, (pixels, offsets) in enumerate(masks):
            one = kept()
            one.binary_mask, one.offsets = pixels, offsets
            data = pickle.dumps(one, protocol=4)
            info = tarfile.TarInfo(f"masks/{n}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        tar.addfile(tarfile.TarInfo("log"))
    del sys.modules["elsewhere"]


def test_mask_archives(spark, tmp_path):
    a, b = np.zeros((3, 4), bool), np.ones((2, 1, 2), bool)
    a[1, 2] = a[2, 0] = True
    archive_of([(a, (10, 20)), (b, (5, 6, 7))], tmp_path / "fov_7.tar.gz")
    out = {tuple(r) for r in mask_archive.load_mask_archives(spark, str(tmp_path / "*.tar.gz")).collect()}
    assert out == {("fov_7", 0, 0, 11, 22), ("fov_7", 0, 0, 12, 20), *(("fov_7", 1, 5 + z, 6, 7 + x) for z in (0, 1) for x in (0, 1))}


def test_mask_archives_run_nothing(tmp_path):
    import io
    import pickle
    import tarfile

    class Evil:
        def __reduce__(self):
            return print, ("ran",)

    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        data = pickle.dumps(Evil())
        info = tarfile.TarInfo("masks/0")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    with pytest.raises(pickle.UnpicklingError):
        mask_archive.masks_of((tmp_path / "x.tar.gz").read_bytes())
