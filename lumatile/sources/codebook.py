"""Codebooks: from JSON documents, lists, arrays, or made up; and back to JSON."""

from __future__ import annotations

import json
import random
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DDL

#: Versions of the codebook document that can be read (fixed values).
VERSIONS = ("0.0.0", "0.0.0")


def from_code_array(spark: SparkSession, codes: list[dict], n_round: int | None = None, n_channel: int | None = None, strict_compat: bool = False) -> DataFrame:
    """A long codebook (code_idx, target, r, c, v) from [{'codeword': [{'r', 'c', 'v'}], 'target'}].

    Sizes too small for the codes are an error. strict_compat: r, c and v must be given and values are
    cut to whole numbers; otherwise r defaults to 0 and v to 1 and fractions are kept.
    """
    rows = []
    for i, code in enumerate(codes):
        if not isinstance(code, dict) or not {"codeword", "target"} <= code.keys():
            raise ValueError("each code must be a mapping with codeword and target")
        for e in code["codeword"]:
            if not isinstance(e, dict) or "c" not in e or strict_compat and not {"r", "v"} <= e.keys():
                raise KeyError("each entry of a codeword must have r, c and v")
            v = float(e.get("v", 1))
            rows.append((i, code["target"], int(e.get("r", 0)), int(e["c"]), float(int(v)) if strict_compat else v))
    for what, given, found in (("rounds", n_round, max((r[2] for r in rows), default=-1) + 1), ("channels", n_channel, max((r[3] for r in rows), default=-1) + 1)):
        if given is not None and given < found:
            raise ValueError(f"{given} {what} given, the codes have {found}")
    return spark.createDataFrame(rows, DDL["codebook"])


def from_numpy(spark: SparkSession, targets: list[str], data) -> DataFrame:
    """From an array [target][round][channel]."""
    if len(targets) != len(data):
        raise ValueError("as many targets as codes are needed")
    rows = [(i, t, r, c, float(v)) for i, (t, code) in enumerate(zip(targets, data, strict=True)) for r, row in enumerate(code) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, DDL["codebook"])


def zeros(spark: SparkSession, targets: list[str], n_round: int, n_channel: int) -> DataFrame:
    return from_numpy(spark, targets, [[[0.0] * n_channel for _ in range(n_round)] for _ in targets])


def synthetic_one_hot(spark: SparkSession, n_round: int, n_channel: int, n_codes: int, names: list[str] | None = None, seed: int = 0) -> DataFrame:
    """n_codes different codes of one channel per round."""
    if n_codes > n_channel**n_round:
        raise ValueError(f"there are {n_channel**n_round} codes only")
    r, seen = random.Random(seed), []
    pool = list(product(range(n_channel), repeat=n_round)) if n_channel**n_round <= 100_000 else None
    while len(seen) < n_codes:
        code = r.choice(pool) if pool else tuple(r.randrange(n_channel) for _ in range(n_round))
        if code not in seen:
            seen.append(code)
    rows = [(i, names[i] if names else f"target_{i}", k, c, 1.0) for i, code in enumerate(seen) for k, c in enumerate(code)]
    return spark.createDataFrame(rows, DDL["codebook"])


def to_codes(codebook: DataFrame, n_round: int, n_channel: int) -> DataFrame:
    """Long to (code_idx, target, trace), cells not given being 0."""
    entry = F.struct((F.col("r") * n_channel + F.col("c")).alias("i"), "v")
    out = codebook.groupBy("code_idx", "target").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    return out.select("code_idx", "target", F.transform(F.sequence(F.lit(0), F.lit(n_round * n_channel - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("trace"))


def read_documents(documents: DataFrame, column: str = "value") -> DataFrame:
    """Codebook documents, one JSON text per row, as long codebooks with the row's other columns.

    Codes are numbered by place in their document. A text that is no document of a known version
    gives no rows; validate.codebook_problems says why.
    """
    kind = "struct<version:string,mappings:array<struct<codeword:array<struct<r:int,c:int,v:double>>,target:string>>>"
    d = documents.withColumn("__d", F.from_json(column, kind)).where(F.col("__d.version").between(*VERSIONS))
    keep = [c for c in documents.columns if c != column]
    m = d.select(*keep, F.posexplode("__d.mappings").alias("code_idx", "__m"))
    return m.select(*keep, "code_idx", F.col("__m.target").alias("target"), F.explode("__m.codeword").alias("__e")).select(
        *keep, "code_idx", "target", F.coalesce("__e.r", F.lit(0)).alias("r"), F.col("__e.c").alias("c"), F.coalesce("__e.v", F.lit(1.0)).alias("v"))


def open_json(spark: SparkSession, path: str) -> DataFrame:
    """A codebook file; lists (a format of old) are refused."""
    text = spark.read.text(path, wholetext=True)
    first = text.first().value
    doc = json.loads(first)
    if isinstance(doc, list):
        raise ValueError("a codebook document must be an object with version and mappings")
    if not VERSIONS[0] <= str(doc.get("version")) <= VERSIONS[1]:
        raise ValueError(f"version {doc.get('version')!r} is not supported")
    return read_documents(text)


def to_documents(codebook: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text per group (all rows if none): entries that aren't 0, v as a number with a fraction."""
    word = codebook.where("v <> 0").groupBy(*by, "code_idx", "target").agg(F.array_sort(F.collect_list(F.struct("r", "c", F.col("v").cast("double").alias("v")))).alias("codeword"))
    m = word.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("code_idx", "codeword", "target"))).alias("m"))
    mappings = F.transform("m", lambda x: F.struct(x["codeword"].alias("codeword"), x["target"].alias("target")))
    return m.select(*by, F.to_json(F.struct(F.lit("0.0.0").alias("version"), mappings.alias("mappings"))).alias("value"))


def to_json(codebook: DataFrame, path: str) -> None:
    to_documents(codebook).coalesce(1).write.text(path)
