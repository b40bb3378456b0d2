"""Learning and applying image transforms."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.registration import phase_shift, similarity, warp as warp_plane
from ..schema import DDL


def learn_translation(tiles: DataFrame, reference: DataFrame, axis: str = "r", upsampling: int = 1, normalization: str | None = None) -> DataFrame:
    """For each label of axis the translation onto the reference (one tile per field of view), as transforms.

    tiles must have one plane per label. The matrix maps output (x, y) to input, as warping needs it.
    """
    if axis not in ("r", "c", "z"):
        raise ValueError(f"no axis {axis!r}")
    many = tiles.groupBy("fov", axis).count().where("count > 1").limit(1).count()
    if many:
        raise ValueError("the stack must have one plane per label of the axis")
    ref = reference.select("fov", F.col("pixels").alias("ref"))
    rows = tiles.join(ref, "fov").select("fov", F.col(axis).alias("label"), "height", "width", "pixels", "ref")

    def run(frames):
        for f in frames:
            out = []
            for fov, lab, h, w, p, q in f.itertuples(index=False):
                dy, dx = phase_shift(np.asarray(q, float).reshape(h, w), np.asarray(p, float).reshape(h, w), upsampling, normalization)
                out.append((fov, lab, similarity(-dx, -dy)))
            yield pd.DataFrame(out, columns=["fov", "label", "matrix"])

    found = rows.mapInPandas(run, "fov string, label int, matrix array<double>")
    sel = [F.col("label").alias(a) if a == axis else F.lit(None).cast("int").alias(a) for a in ("r", "c", "z")]
    return found.select("fov", *sel, F.lit("similarity").alias("type"), "matrix")


def apply_warp(tiles: DataFrame, transforms: DataFrame) -> DataFrame:
    """Every tile warped by the transform whose selectors (NULL: any) match it; others stay as they are. Transforms are a few per field of view."""
    t = transforms.select(*(F.col(c).alias(f"t_{c}") for c in ("fov", "r", "c", "z")), "matrix")
    match = (F.col("fov") == F.col("t_fov")) & (F.col("t_r").isNull() | (F.col("r") == F.col("t_r"))) & (F.col("t_c").isNull() | (F.col("c") == F.col("t_c"))) & (F.col("t_z").isNull() | (F.col("z") == F.col("t_z")))
    kind = np.float64 if dict(tiles.dtypes)["pixels"] == "array<double>" else np.float32
    both = tiles.join(t, match, "left").select("fov", "r", "c", "z", "height", "width", "pixels", "matrix")

    def run(frames):
        for f in frames:
            out = [p if m is None else warp_plane(np.asarray(p, float).reshape(h, w), list(m)).astype(kind).ravel() for p, h, w, m in zip(f["pixels"], f["height"], f["width"], f["matrix"], strict=True)]
            yield f.drop(columns="matrix").assign(pixels=out)

    return both.mapInPandas(run, tiles.select("fov", "r", "c", "z", "height", "width", "pixels").schema)


def transforms_to_json(transforms: DataFrame) -> str:
    """A transforms list as a JSON document: selector, type and 3 x 3 matrix each."""
    rows = transforms.orderBy("fov", "r", "c", "z").collect()  # a few per field of view
    items = [[{k: r[k] for k in ("fov", "r", "c", "z") if r[k] is not None}, r["type"], [r["matrix"][i : i + 3] for i in (0, 3, 6)]] for r in rows]
    return json.dumps({"version": "0.0.0", "transforms_list": items})


def transforms_from_json(spark: SparkSession, text: str) -> DataFrame:
    rows = [(s.get("fov"), s.get("r"), s.get("c"), s.get("z"), kind, [float(v) for row in m for v in row]) for s, kind, m in json.loads(text)["transforms_list"]]
    return spark.createDataFrame(rows, DDL["transforms"])
