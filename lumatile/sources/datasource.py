"""A Spark data source of tiles made by a function, one input partition per tile: spark.read.format("tiles")."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import DDL


class TilePartition(InputPartition):
    def __init__(self, fov: str, r: int, c: int, z: int) -> None:
        super().__init__((fov, r, c, z))


def tile_source(fetch: Callable[[str, int, int, int], np.ndarray]) -> type[DataSource]:
    """A data source named "tiles" whose pixels come from fetch(fov, r, c, z) in [0, 1].

    Options: fovs, rounds, chs, zplanes, comma-separated: only their tiles are fetched, each in a task
    of its own. Filters aren't pushed into the reader: Spark 4.1 keeps those of one query for the next
    ones over the same loaded table.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            split = lambda k: options[k].split(",")
            self.axes = {"fov": split("fovs"), "r": [int(v) for v in split("rounds")], "c": [int(v) for v in split("chs")], "z": [int(v) for v in split("zplanes")]}

        def partitions(self) -> list[TilePartition]:
            a = self.axes
            return [TilePartition(f, r, c, z) for f in a["fov"] for r in a["r"] for c in a["c"] for z in a["z"]]

        def read(self, partition: TilePartition) -> Iterator[pa.RecordBatch]:
            if partition is None or partition.value is None:  # Spark asks so where no partition is left
                return
            fov, r, c, z = partition.value
            a = np.asarray(fetch(fov, r, c, z), np.float32)
            if a.min(initial=0) < 0 or a.max(initial=0) > 1:
                raise ValueError("values must lie in [0, 1]")
            i = pa.int32()
            yield pa.RecordBatch.from_arrays(
                [pa.array([fov]), pa.array([r], i), pa.array([c], i), pa.array([z], i), pa.array([a.shape[0]], i), pa.array([a.shape[1]], i), pa.array([a.ravel()], pa.list_(pa.float32()))],
                names=["fov", "r", "c", "z", "height", "width", "pixels"],
            )

    class Tiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tiles"

        def schema(self) -> str:
            return DDL["tiles"]

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Tiles


def register(spark: SparkSession, fetch: Callable[[str, int, int, int], np.ndarray]) -> None:
    spark.dataSource.register(tile_source(fetch))
