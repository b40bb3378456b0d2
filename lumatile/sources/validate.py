"""Rules for documents: what is wrong with each, on the driver for one, as columns for many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = r"^\d+\.\d+\.\d+$"


def _is_version(v) -> bool:
    import re

    return isinstance(v, str) and re.match(VERSION, v) is not None


def experiment_problems(doc) -> list[str]:
    """What is wrong with an experiment document."""
    if not isinstance(doc, dict):
        return ["not an object"]
    out = [f"{k} is missing" for k in ("version", "codebook", "extras") if k not in doc]
    if not _is_version(doc.get("version")):
        out.append("version is not x.y.z")
    elif int(doc["version"].split(".")[0]) >= 5:
        images = doc.get("images")
        if not isinstance(images, dict) or "primary" not in images:
            out.append("images must be an object with primary")
        elif not all(isinstance(v, str) for v in images.values()):
            out.append("images must name documents")
    elif not isinstance(doc.get("primary_images"), str):
        out.append("primary_images is missing")
    if "codebook" in doc and not isinstance(doc["codebook"], str):
        out.append("codebook must name a document")
    return out


def manifest_problems(doc) -> list[str]:
    if not isinstance(doc, dict):
        return ["not an object"]
    out = [] if _is_version(doc.get("version")) else ["version is not x.y.z"]
    if not isinstance(doc.get("contents"), dict) or not all(isinstance(v, str) for v in doc["contents"].values()):
        out.append("contents must map names to documents")
    return out


def fov_problems(doc) -> list[str]:
    if not isinstance(doc, dict):
        return ["not an object"]
    out = [] if _is_version(doc.get("version")) else ["version is not x.y.z"]
    if not isinstance(doc.get("dimensions"), list):
        out.append("dimensions must be a list")
    if not isinstance(doc.get("shape"), dict):
        out.append("shape must be an object")
    if not isinstance(doc.get("tiles"), list) or not doc["tiles"]:
        return [*out, "tiles must be a list of some"]
    for i, t in enumerate(doc["tiles"]):
        if not isinstance(t, dict) or not {"coordinates", "indices", "file"} <= t.keys():
            out.append(f"tile {i} lacks coordinates, indices or file")
        elif not {"r", "c"} <= t["indices"].keys() or not all(isinstance(v, int) and v >= 0 for v in t["indices"].values()):
            out.append(f"tile {i} has bad indices")
        elif not {"xc", "yc"} <= t["coordinates"].keys():
            out.append(f"tile {i} lacks xc or yc")
    return out


def codebook_document_problems(doc) -> list[str]:
    if not isinstance(doc, dict):
        return ["not an object"]
    out = [] if _is_version(doc.get("version")) else ["version is not x.y.z"]
    if not isinstance(doc.get("mappings"), list) or not doc["mappings"]:
        return [*out, "mappings must be a list of some"]
    for i, m in enumerate(doc["mappings"]):
        if not isinstance(m, dict) or not isinstance(m.get("target"), str) or not isinstance(m.get("codeword"), list) or not m["codeword"]:
            out.append(f"mapping {i} lacks codeword or target")
        elif not all(isinstance(e, dict) and isinstance(e.get("c"), int) and 0 <= e.get("v", 1) <= 1 and e.get("r", 0) >= 0 for e in m["codeword"]):
            out.append(f"mapping {i} has a bad entry")
    return out


#: Checks by kind of document.
RULES = {"experiment": experiment_problems, "manifest": manifest_problems, "fov": fov_problems, "codebook": codebook_document_problems}


def codebook_problems(documents: DataFrame, column: str = "value") -> DataFrame:
    """documents with problem: why the JSON text isn't a codebook, NULL if it is; in SQL, for any number of documents."""
    kind = "struct<version:string,mappings:array<struct<codeword:array<struct<r:int,c:int,v:double>>,target:string>>>"
    d = F.from_json(column, kind)
    m = F.col("__d.mappings")
    bad = F.exists(m, lambda x: x["target"].isNull() | x["codeword"].isNull() | (F.size(x["codeword"]) == 0))
    entry = F.exists(m, lambda x: F.exists(x["codeword"], lambda e: e["c"].isNull() | (e["c"] < 0) | (F.coalesce(e["r"], F.lit(0)) < 0) | ~F.coalesce(e["v"], F.lit(1.0)).between(0, 1)))
    problem = F.when(F.try_parse_json(F.col(column)).isNull(), "not JSON").when(~F.coalesce(F.col("__d.version").rlike(VERSION), F.lit(False)), "version").when(m.isNull() | (F.size(m) == 0), "mappings").when(bad, "mapping").when(entry, "entry")
    return documents.withColumn("__d", d).withColumn("problem", problem).drop("__d")
