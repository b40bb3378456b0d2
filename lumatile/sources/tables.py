"""Readers and writers of spot, mask, label and matrix tables, synthetic data, provenance and settings."""

from __future__ import annotations

import functools
import json
import platform
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..schema import DDL, DECODED_SPOT_FIELDS, SPOT_FIELDS, require


def save(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Any table as Parquet."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)


def load(spark: SparkSession, path: str, needs: tuple[str, ...] = ()) -> DataFrame:
    return require(spark.read.parquet(path), needs, path)


def load_spots(spark: SparkSession, path: str) -> DataFrame:
    """Spot attributes from JSON lines; x, y, z and radius must be there."""
    return require(spark.read.json(path), SPOT_FIELDS, "spot table")


def save_spots(spots: DataFrame, path: str) -> None:
    require(spots, SPOT_FIELDS, "spot table").write.json(path)


def save_decoded_csv(decoded: DataFrame, path: str) -> None:
    require(decoded, DECODED_SPOT_FIELDS, "decoded spots").write.option("header", True).csv(path)


def load_decoded_csv(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.option("header", True).option("inferSchema", True).csv(path), DECODED_SPOT_FIELDS, "decoded spots")


def mermaid(decoded: DataFrame) -> DataFrame:
    """x, y, target, target: rows for a viewer that takes gzipped CSV; write with save_mermaid."""
    return decoded.select("x", "y", F.col("target").alias("target"), F.col("target").alias("target_2"))


def save_mermaid(decoded: DataFrame, path: str) -> None:
    mermaid(decoded).write.option("compression", "gzip").option("header", True).csv(path)


def geojson(spots: DataFrame) -> DataFrame:
    """One GeoJSON feature per spot, as text: a point with its radius."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("coordinates"))
    return spots.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("radius").alias("properties"))).alias("value"))


def from_label_array(spark: SparkSession, labels: np.ndarray, fov: str = "fov_000") -> DataFrame:
    """A label table of a whole-number array of two or three axes."""
    if not np.issubdtype(labels.dtype, np.integer):
        raise TypeError("labels must be whole numbers")
    a = labels[None] if labels.ndim == 2 else labels
    at = np.argwhere(a)
    return spark.createDataFrame([(fov, *map(int, p), int(a[tuple(p)])) for p in at], DDL["labels"])


def from_binary_arrays(spark: SparkSession, arrays: list[np.ndarray], fov: str = "fov_000") -> DataFrame:
    """Masks of boolean arrays of equal shape."""
    if len({a.shape for a in arrays}) > 1:
        raise ValueError("masks must have one shape")
    rows = [(fov, i, *map(int, p)) for i, a in enumerate(arrays) for p in np.argwhere(a[None] if a.ndim == 2 else a)]
    return spark.createDataFrame(rows, DDL["mask_pixels"])


def synthetic_spots(spark: SparkSession, codes: DataFrame, rounds: int, channels: int, n_spots: int, height: int = 50, width: int = 45, planes: int = 10, seed: int = 0, jitter: float = 0.0, photons: float = 1.0) -> DataFrame:
    """Spots that spell codes: each of n_spots draws a code and a place and shows in every round in the code's channel. Seeded, made on the executors."""
    book = codes.select("code_idx", "target", "trace")
    n = book.count()
    base = spark.range(n_spots).select(F.col("id").alias("molecule"), F.floor(F.rand(seed) * n).cast("int").alias("k"), *((F.rand(seed + i) * (size - 1)).alias(a) for i, (a, size) in enumerate((("z", planes), ("y", height), ("x", width)), 1)))
    from pyspark.sql import Window

    numbered = book.withColumn("k", (F.row_number().over(Window.orderBy("code_idx")) - 1).cast("int"))  # a codebook
    cell = base.join(numbered, "k").select("molecule", "target", "z", "y", "x", F.posexplode("trace").alias("i", "v")).where("v > 0")
    moved = {a: F.col(a) + F.lit(jitter) * (F.rand(seed + 10 + i) - 0.5) * 2 for i, a in enumerate(("y", "x"))} if jitter else {}
    out = cell.withColumns({"r": F.floor(F.col("i") / channels).cast("int"), "c": (F.col("i") % channels).cast("int"), **moved})
    return out.select(F.lit("fov_000").alias("fov"), "r", "c", (F.col("molecule") * rounds + F.col("r")).alias("spot_id"), "z", "y", "x", F.lit(1.0).alias("radius"), (F.col("v") * photons).alias("intensity"), "target", "molecule")


def synthetic_tiles(spots: DataFrame, rounds: int, channels: int, planes: int, height: int, width: int, sigma: tuple[float, float, float] = (1.0, 1.5, 1.5), background: float = 0.02, noise: float = 0.005, seed: int = 0) -> DataFrame:
    """A blurred, noisy image of spots: one volume per round and channel, made in one task each."""
    import pandas as pd

    from ..kernels.filters import gaussian

    def run(f: pd.DataFrame) -> pd.DataFrame:
        fov, r, c = f["fov"].iloc[0], int(f["r"].iloc[0]), int(f["c"].iloc[0])
        a = np.zeros((planes, height, width))
        real = f[f["intensity"] > 0]
        at = np.round(real[["z", "y", "x"]].to_numpy(float)).astype(int)
        np.add.at(a, tuple(at.clip(0, np.array(a.shape) - 1).T), real["intensity"].to_numpy(float))
        a = gaussian(a, sigma)
        a = a / (a.max() or 1) * 0.9 + background + np.random.default_rng([seed, r, c]).normal(0, noise, a.shape)
        return pd.DataFrame([(fov, r, c, z, height, width, a[z].clip(0, 1).astype(np.float32).ravel()) for z in range(planes)], columns=["fov", "r", "c", "z", "height", "width", "pixels"])

    empty = spots.sparkSession.createDataFrame([("fov_000", r, c, 0.0, 0.0, 0.0, 0.0) for r in range(rounds) for c in range(channels)], "fov string, r int, c int, z double, y double, x double, intensity double")
    return spots.select("fov", "r", "c", "z", "y", "x", "intensity").unionByName(empty).groupBy("fov", "r", "c").applyInPandas(run, DDL["tiles"])


def synthetic_intensities(spark: SparkSession, codes: DataFrame, n_spots: int, height: int = 50, width: int = 45, planes: int = 10, fluorophores: float = 200, photons: float = 50, seed: int = 0) -> DataFrame:
    """Features of n_spots at random places with Poisson-noisy traces of random codes, scaled to 1; every row has its own seed."""
    import pandas as pd

    book = [(r.target, np.array(r.trace)) for r in codes.orderBy("code_idx").collect()]  # a codebook

    def run(frames):
        for f in frames:
            rows = []
            for i in f["id"]:
                g = np.random.default_rng([seed, int(i)])
                target, trace = book[int(g.integers(len(book)))]
                z, y, x = g.random(3) * (np.array([planes, height, width]) - 1)
                bright = g.poisson(g.poisson(fluorophores * trace) * photons).astype(float)
                rows.append(("fov_000", i, z, y, x, 1.0, (bright / (fluorophores * photons * 2)).clip(0, 1).tolist(), target))
            yield pd.DataFrame(rows, columns=["fov", "feature_id", "z", "y", "x", "radius", "trace", "target"])

    return spark.range(n_spots).mapInPandas(run, DDL["features"] + ", target STRING")


class Log:
    """Provenance: what ran, with which arguments."""

    def __init__(self) -> None:
        self.steps: list[tuple] = []

    def add(self, method: str, arguments: dict) -> None:
        plain = {k: v if isinstance(v, (int, float, str, bool, list, tuple, type(None))) else type(v).__name__ for k, v in arguments.items()}
        self.steps.append((len(self.steps), method, json.dumps(plain, sort_keys=True), __version__))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.steps, DDL["provenance"])

    def environment(self) -> dict:
        import pyspark

        return {"os": platform.platform(), "python": platform.python_version(), "spark": pyspark.__version__, "numpy": np.__version__}


def logged(log: Log) -> Callable:
    """A decorator that records an operator's calls."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kwargs):
            names = f.__code__.co_varnames[: f.__code__.co_argcount]
            log.add(f.__name__, {**dict(zip(names, args, strict=False)), **kwargs})
            return f(*args, **kwargs)

        return call

    return wrap


def settings(spark: SparkSession) -> dict[str, str]:
    """The engine's settings, from spark.lumatile.* with defaults."""
    default = {"strict": "false", "verbose": "false"}
    return {k: spark.conf.get(f"spark.lumatile.{k}", v) for k, v in default.items()}
