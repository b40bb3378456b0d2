"""Masks from gzipped tar archives that hold a pickled mask each under masks/, read without running what the pickles name."""

from __future__ import annotations

import io
import os
import pickle
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import DDL


class _Mask:
    """What a pickled mask becomes: its attributes, among them binary_mask and offsets."""


#: Callables that arrays are rebuilt by (fixed values, module and name); a class named MaskOnDisk becomes _Mask, and all else is refused.
ARRAYS = {(f"numpy.{core}.multiarray", name) for core in ("core", "_core") for name in ("_reconstruct", "scalar")} | {("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode")}


class _Reader(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if name.rpartition(".")[2] == "MaskOnDisk":
            return _Mask
        if (module, name) in ARRAYS:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} has no place in a mask")


def masks_of(content: bytes) -> list[tuple[np.ndarray, tuple[int, ...]]]:
    """(pixels, offsets) of each mask of an archive, in order."""
    found = []
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
        for member in archive:
            if member.isfile() and member.name.startswith("masks/"):
                mask = _Reader(archive.extractfile(member)).load()
                pixels = getattr(mask, "binary_mask", None)
                if not isinstance(mask, _Mask) or not isinstance(pixels, np.ndarray) or pixels.ndim not in (2, 3):
                    raise ValueError(f"{member.name} is not a mask of two or three axes")
                found.append((pixels.astype(bool), tuple(int(v) for v in mask.offsets)))
    return found


def _pixels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, content in zip(f["path"], f["content"], strict=True):
            fov = os.path.basename(path).removesuffix(".gz").removesuffix(".tar").removesuffix(".tgz")
            for i, (pixels, offsets) in enumerate(masks_of(content)):
                at = np.argwhere(pixels) + np.array(offsets, int)
                z = at[:, 0] if pixels.ndim == 3 else np.zeros(len(at), int)
                out = pd.DataFrame({"fov": fov, "mask_id": i, "z": z, "y": at[:, -2], "x": at[:, -1]})
                yield out.astype({k: "int32" for k in ("mask_id", "z", "y", "x")})


def load_mask_archives(spark: SparkSession, path: str) -> DataFrame:
    """mask_pixels of all archives at the path (a file, a folder or a pattern); an archive is a field of view by its file's name, its masks count from 0."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_pixels, DDL["mask_pixels"])
