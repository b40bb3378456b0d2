"""Table schemas and axis names.

Images exist in two forms: tiles (a plane's pixels as one array, for image kernels) and pixels
(one row per voxel, for everything that SQL can say). Inside Spark "no call" and "not seen" are
NULL; text such as 'nan' appears at the edges only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Axes with integer labels, pixel axes, and the names of physical coordinates.
LABELLED, PIXEL_AXES = ("r", "c", "z"), ("y", "x")
AXES = (*LABELLED, *PIXEL_AXES)
PHYSICAL = {"xc": "x", "yc": "y", "zc": "z"}

DDL = {
    "tiles": "fov STRING, r INT, c INT, z INT, height INT, width INT, pixels ARRAY<FLOAT>",
    "pixels": "fov STRING, r INT, c INT, z INT, y INT, x INT, value DOUBLE",
    "axis_ticks": "fov STRING, axis STRING, idx INT, phys DOUBLE",
    "codebook": "code_idx INT, target STRING, r INT, c INT, v DOUBLE",
    "codes": "code_idx INT, target STRING, trace ARRAY<DOUBLE>",
    "spots": "fov STRING, r INT, c INT, spot_id BIGINT, z DOUBLE, y DOUBLE, x DOUBLE, radius DOUBLE, intensity DOUBLE",
    "features": "fov STRING, feature_id BIGINT, z DOUBLE, y DOUBLE, x DOUBLE, radius DOUBLE, trace ARRAY<DOUBLE>",
    "mask_pixels": "fov STRING, mask_id INT, z INT, y INT, x INT",
    "labels": "fov STRING, z INT, y INT, x INT, label INT",
    "transforms": "fov STRING, r INT, c INT, z INT, type STRING, matrix ARRAY<DOUBLE>",
    "expression": "cell_id STRING, gene STRING, n BIGINT",
    "provenance": "step INT, method STRING, arguments STRING, version STRING",
}
#: Columns that a spot table must have; others pass through.
SPOT_FIELDS = ("x", "y", "z", "radius")
DECODED_SPOT_FIELDS = ("xc", "yc", "target")


def struct(table: str) -> StructType:
    """A table's schema; needs a session, which parses it."""
    return StructType.fromDDL(DDL[table])


def require(df: DataFrame, names: tuple[str, ...], what: str) -> DataFrame:
    """df, if it has the named columns; ValueError otherwise."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks columns {missing}")
    return df
