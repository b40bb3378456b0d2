"""Experiments: a document, manifests of fields of view, tiles; structured folders; and writing them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DDL

#: Document versions (fixed values): from MAP_FROM on, images are one map.
MAP_FROM = 5
PRIMARY = "primary"
#: Names of files of a structured folder (fixed pattern).
STRUCTURED = r"^(?P<prefix>.+)-f(?P<f>\d+)-r(?P<r>\d+)-c(?P<c>\d+)-z(?P<z>\d+)\.(?P<ext>[^.]+)$"

_TILE = "struct<coordinates:map<string,string>,indices:map<string,int>,file:string,tile_format:string,sha256:string,tile_shape:map<string,int>,extras:map<string,string>>"
_FOV = f"struct<version:string,dimensions:array<string>,shape:map<string,int>,default_tile_format:string,default_tile_shape:map<string,int>,tiles:array<{_TILE}>>"


def _base(path: str) -> str:
    return path.rsplit("/", 1)[0]


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def images_of(document: dict) -> dict[str, str]:
    """image type -> manifest of an experiment document of any version; the primary type must be there."""
    major = int(str(document["version"]).split(".")[0])
    found = dict(document["images"]) if major >= MAP_FROM else {PRIMARY: document["primary_images"], **document.get("auxiliary_images", {})}
    if PRIMARY not in found:
        raise ValueError("the experiment has no primary images")
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(fov, path): the fields of view of a manifest, or the one of a field-of-view document itself."""
    doc = json.loads(_text(spark, path))
    if "contents" not in doc:
        return spark.createDataFrame([("fov_000", path)], "fov string, path string")
    return spark.createDataFrame([(k, f"{_base(path)}/{v}") for k, v in doc["contents"].items()], "fov string, path string")


def coordinates(value: str) -> tuple:
    """(min, max) of a coordinate that is a number or a pair, as SQL."""
    pair = f"from_json({value}, 'array<double>')"
    return F.expr(f"coalesce({pair}[0], CAST({value} AS DOUBLE))"), F.expr(f"coalesce({pair}[1], CAST({value} AS DOUBLE))")


def read_fov_documents(documents: DataFrame) -> DataFrame:
    """(fov, image_type, path, value: JSON text) -> tiles index: labels, file, format, shape, extents, hash and extras, one row per tile."""
    d = documents.withColumn("__d", F.from_json("value", _FOV)).where("__d IS NOT NULL")
    t = d.select("fov", "image_type", "path", "__d", F.explode("__d.tiles").alias("t"))
    cols = {}
    for a in ("xc", "yc", "zc"):
        t = t.withColumn(f"__{a}", F.expr(f"t.coordinates['{a}']"))
        cols[f"{a}_min"], cols[f"{a}_max"] = coordinates(f"__{a}")
    shape = F.coalesce("t.tile_shape", "__d.default_tile_shape")
    return t.select(
        "fov", "image_type", *(F.expr(f"t.indices['{a}']").alias(a) for a in ("r", "c", "z")), shape["y"].alias("height"), shape["x"].alias("width"),
        F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("t.file")).alias("file"), F.coalesce("t.tile_format", "__d.default_tile_format").alias("tile_format"),
        F.col("t.sha256").alias("sha256"), *(c.alias(n) for n, c in cols.items()), F.col("t.extras").alias("extras"),
    )


def from_json(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """(tile index, codebook, extras) of an experiment. strict: documents that break the rules are an error."""
    from .codebook import open_json
    from .validate import experiment_problems

    doc = json.loads(_text(spark, path))
    if strict and (bad := experiment_problems(doc)):
        raise ValueError("; ".join(bad))
    base = _base(path)
    parts = None
    for kind, name in images_of(doc).items():
        m = manifest(spark, f"{base}/{name}").withColumn("image_type", F.lit(kind))
        parts = m if parts is None else parts.unionByName(m)
    paths = [r.path for r in parts.select("path").distinct().collect()]  # the experiment's fields of view
    texts = spark.read.text(paths, wholetext=True).withColumn("__p", F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"))
    texts = parts.withColumn("__p", F.regexp_replace("path", "^file:/*", "/")).join(texts, "__p").drop("__p")
    return read_fov_documents(texts), open_json(spark, f"{base}/{doc['codebook']}"), doc.get("extras", {})


def load_tiles(index: DataFrame, decode: Callable[[bytes, str, int, int], np.ndarray] | None = None) -> DataFrame:
    """Tiles of an index, each file read by Spark and decoded in Arrow batches. Only the tiles left in the index are read.

    decode(content, format, height, width) -> array; by default TIFF, NUMPY files and raw little-endian
    float32 ('RAW'). Values of whole-number types are scaled by their type's largest value; all
    must end in [0, 1].
    """
    spark = index.sparkSession
    files = [r.file for r in index.select("file").distinct().collect()]  # names, as Spark's file index holds them too
    content = spark.read.format("binaryFile").load(files).select(F.regexp_replace("path", "^file:/*", "/").alias("__p"), "content")
    both = index.withColumn("__p", F.regexp_replace("file", "^file:/*", "/")).join(content, "__p").select("fov", "r", "c", "z", "height", "width", "tile_format", "content")
    read = decode or decode_tile

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for fov, r, c, z, h, w, kind, raw in f.itertuples(index=False):
                a = as_float(read(bytes(raw), kind, int(h) if h == h and h else 0, int(w) if w == w and w else 0))
                rows.append((fov, r, c, z, a.shape[0], a.shape[1], a.ravel()))
            yield pd.DataFrame(rows, columns=["fov", "r", "c", "z", "height", "width", "pixels"])

    return both.mapInPandas(run, DDL["tiles"])


def decode_tile(raw: bytes, kind: str, height: int, width: int) -> np.ndarray:
    import io

    if kind.upper() in ("NUMPY", "NPY"):
        return np.load(io.BytesIO(raw), allow_pickle=False)
    if kind.upper() in ("TIFF", "TIF"):
        from .tiff import read_pages

        return read_pages(raw)[0]
    if kind.upper() == "RAW":
        return np.frombuffer(raw, "<f4").reshape(height, width)
    raise ValueError(f"format {kind!r} needs a decode function")


def as_float(a: np.ndarray) -> np.ndarray:
    """float32 in [0, 1]; unsigned whole numbers by their largest value, signed ones likewise, below 0 not allowed."""
    out = (a / np.iinfo(a.dtype).max if np.issubdtype(a.dtype, np.integer) else a).astype(np.float32)
    if out.size and (out.min() < 0 or out.max() > 1):
        raise ValueError("values must lie in [0, 1]")
    return out


def from_tilefetcher(spark: SparkSession, fetch: Callable[[str, int, int, int], np.ndarray], fovs: list[str], rounds: list[int], chs: list[int], zplanes: list[int]) -> DataFrame:
    """Tiles from a user's function fetch(fov, r, c, z), called where each tile is needed."""
    keys = spark.createDataFrame([(f, r, c, z) for f in fovs for r in rounds for c in chs for z in zplanes], "fov string, r int, c int, z int")

    def run(frames):
        for f in frames:
            rows = []
            for fov, r, c, z in f.itertuples(index=False):
                a = as_float(np.asarray(fetch(fov, r, c, z)))
                rows.append((fov, r, c, z, *a.shape, a.ravel()))
            yield pd.DataFrame(rows, columns=["fov", "r", "c", "z", "height", "width", "pixels"])

    return keys.repartition("fov", "r", "c", "z").mapInPandas(run, DDL["tiles"])


def from_numpy(spark: SparkSession, data: np.ndarray, fov: str = "fov_000", labels: dict[str, list[int]] | None = None) -> DataFrame:
    """Tiles of a five-dimensional array (r, c, z, y, x) with the given labels."""
    if data.ndim != 5:
        raise ValueError("five axes are needed")
    labels = labels or {}
    rs, cs, zs = (labels.get(a, list(range(n))) for a, n in zip("rcz", data.shape, strict=False))
    a = as_float(data)
    rows = [(fov, r, c, z, data.shape[3], data.shape[4], a[i, j, k].ravel().tolist()) for i, r in enumerate(rs) for j, c in enumerate(cs) for k, z in enumerate(zs)]
    return spark.createDataFrame(rows, DDL["tiles"])


def axis_ticks(index: DataFrame) -> DataFrame:
    """Physical coordinates of a tile index: x and y evenly spaced over the tile's extent, z the middle of each plane's."""
    plane = index.groupBy("fov").agg(*(F.first(c).alias(c) for c in ("height", "width", "xc_min", "xc_max", "yc_min", "yc_max")))
    parts = []
    for axis, n, lo, hi in (("x", "width", "xc_min", "xc_max"), ("y", "height", "yc_min", "yc_max")):
        step = F.try_divide(F.col(hi) - F.col(lo), F.col(n) - 1)
        parts.append(plane.select("fov", F.lit(axis).alias("axis"), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("idx"), lo, step.alias("s")).select("fov", "axis", "idx", (F.col(lo) + F.col("idx") * F.coalesce("s", F.lit(0.0))).alias("phys")))
    z = index.groupBy("fov", F.col("z").alias("idx")).agg(((F.first("zc_min") + F.first("zc_max")) / 2).alias("phys")).select("fov", F.lit("z").alias("axis"), "idx", "phys")
    return parts[0].unionByName(parts[1]).unionByName(z)


def parse_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Names of a structured folder as prefix, f, r, c, z, ext; rows whose name doesn't fit are left out."""
    group = ("prefix", "f", "r", "c", "z", "ext")
    java = STRUCTURED.replace("?P<", "?<")
    out = names.where(F.col(column).rlike(java))
    for i, g in enumerate(group, 1):
        v = F.regexp_extract(column, java, i)
        out = out.withColumn(g, v if g in ("prefix", "ext") else v.cast("int"))
    return out


def structured_dataset(names: DataFrame, coords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed names joined with their coordinates (fov, round, ch, zplane, xc_min, ...), and coordinates without a file.

    A file without coordinates is an error, raised when its row is read.
    """
    parsed = parse_names(names)
    key = {"f": "fov", "r": "round", "c": "ch", "z": "zplane"}
    c = coords.withColumnsRenamed({v: k for k, v in key.items()})
    both = parsed.join(c.withColumn("__there", F.lit(True)), list(key), "left")
    checked = both.withColumn("__there", F.when(F.col("__there"), True).otherwise(F.raise_error(F.concat(F.lit("no coordinates for "), F.col("name"))).cast("boolean"))).where("__there").drop("__there")
    extra = c.join(parsed.select(*key), list(key), "left_anti")
    return checked, extra


def _in_order(a, b):
    key = lambda t: F.struct(t["r"], t["c"], t["z"])  # noqa: E731  a tile's maps have no order
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


#: Tiles of one document, about, where a field of view's may be several.
DOCUMENT_TILES = 4096


def fov_documents(index: DataFrame, tiles: int | None = None) -> DataFrame:
    """(fov, image_type, value): field-of-view documents of a tile index, as JSON text.

    tiles: a field of view of more tiles gets several documents of about as many, each with the
    whole one's shape, so that no task holds all its tiles; read_fov_documents takes them together.
    """
    whole = index.groupBy("fov", "image_type").agg(*((F.max(a) + 1).alias(f"n_{a}") for a in ("r", "c", "z")), F.first("tile_format").alias("fmt"), F.count("*").alias("__n"))
    part = F.lit(0) if tiles is None else F.pmod(F.xxhash64("r", "c", "z"), F.ceil(F.col("__n") / tiles))
    coords = F.create_map(*(x for a in ("xc", "yc", "zc") for x in (F.lit(a), F.array(F.col(f"{a}_min"), F.col(f"{a}_max")))))
    tile = F.struct(coords.alias("coordinates"), F.create_map(*(x for a in ("r", "c", "z") for x in (F.lit(a), F.col(a)))).alias("indices"), "file", "tile_format", "sha256", F.create_map(F.lit("y"), F.col("height"), F.lit("x"), F.col("width")).alias("tile_shape"))
    own = index.join(whole.select("fov", "image_type", "__n"), ["fov", "image_type"]).withColumn("__part", part)
    g = own.groupBy("fov", "image_type", "__part").agg(F.collect_list(F.struct("r", "c", "z", tile.alias("t"))).alias("t")).join(whole, ["fov", "image_type"])
    doc = F.struct(F.lit("0.1.0").alias("version"), F.array(*map(F.lit, ("x", "y", "z", "r", "c"))).alias("dimensions"), F.create_map(*(x for a in ("r", "c", "z") for x in (F.lit(a), F.col(f"n_{a}")))).alias("shape"), F.col("fmt").alias("default_tile_format"), F.transform(F.array_sort("t", _in_order), lambda x: x["t"]).alias("tiles"))
    return g.select("fov", "image_type", F.to_json(doc).alias("value"))


def write_experiment(index: DataFrame, codebook: DataFrame, folder: str, extras: dict | None = None) -> None:
    """An experiment's documents: tile documents and manifests in Spark's text files, the rest by name.

    Documents are small; tiles stay where they are.
    """
    from .codebook import to_documents
    from .files import write_text

    spark = index.sparkSession
    kinds: dict[str, str] = {}
    docs = fov_documents(index)
    for kind in sorted(r.image_type for r in docs.select("image_type").distinct().collect()):
        names = {}
        for r in docs.where(F.col("image_type") == kind).toLocalIterator():  # one document at a time
            names[r.fov] = f"{kind}-{r.fov}.json"
            write_text(spark, f"{folder}/{names[r.fov]}", r.value)
        kinds[kind] = f"{kind}.json"
        write_text(spark, f"{folder}/{kind}.json", json.dumps({"version": "0.1.0", "contents": names, "extras": None}))
    write_text(spark, f"{folder}/codebook.json", to_documents(codebook).first().value)
    write_text(spark, f"{folder}/experiment.json", json.dumps({"version": "5.0.0", "images": kinds, "codebook": "codebook.json", "extras": extras or {}}))


def save_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles as Parquet, a folder per field of view, so that reading one prunes the others."""
    tiles.repartition("fov").write.partitionBy("fov").parquet(path)


def multipage_tiffs(tiles: DataFrame) -> DataFrame:
    """(fov, content): each field of view's planes as one TIFF file, pages in order of r, z, c. A field of view's tiles meet in one task."""
    from .tiff import write_pages

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["r", "z", "c"])
        pages = [np.asarray(p, np.float32).reshape(h, w) for p, h, w in zip(f["pixels"], f["height"], f["width"], strict=True)]
        return pd.DataFrame({"fov": [f["fov"].iloc[0]], "content": [write_pages(pages)]})

    return tiles.groupBy("fov").applyInPandas(run, "fov string, content binary")
