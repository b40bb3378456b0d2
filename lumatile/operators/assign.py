"""Spots to cells to a cell by gene matrix; joining fields of view."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut


def assign_targets(decoded: DataFrame, mask_pixels: DataFrame, use_z: bool = True, fields: DataFrame | None = None) -> DataFrame:
    """decoded features with cell_id, the name of the last mask that holds their pixel; NULL outside all masks.

    Pixel of a feature: its coordinates rounded down. An equi-join on the pixel after one mask per
    pixel is chosen, so masks never multiply features. The pixels are shuffled: estimates of their size
    don't count what masks are spread to, and they would be broadcast. fields: decoded's fields of view (fov),
    if they are cheaper to get than pixels to shuffle; masks elsewhere are left out where they are.
    """
    if fields is not None:
        mask_pixels = mask_pixels.join(F.broadcast(fields.select("fov").distinct()), "fov", "left_semi")  # a row per field of view
    at = ["fov", *(("z",) if use_z else ()), "y", "x"]
    top = mask_pixels.groupBy(*at).agg(F.max("mask_id").alias("__mask")).select(*(F.col(a).alias(f"__{a}") for a in at), "__mask")
    cond = [decoded["fov"] == top["__fov"]] + [F.floor(decoded[a]).cast("int") == top[f"__{a}"] for a in at[1:]]
    return decoded.join(top.hint("merge"), cond, "left").withColumn("cell_id", F.col("__mask").cast("string")).drop("__mask", *(f"__{a}" for a in at))


def expression_long(decoded: DataFrame) -> DataFrame:
    """(cell_id, gene, n): counts of decoded features; features in no cell count for 'unassigned'. Features without a target aren't genes."""
    cell = F.coalesce("cell_id", F.lit("unassigned")).alias("cell_id")
    return decoded.where(F.col("target").isNotNull()).groupBy(cell, F.col("target").alias("gene")).agg(F.count("*").alias("n"))


def cells(decoded: DataFrame) -> DataFrame:
    """A row per cell: the middle of its features' extent on every coordinate they have, area (NULL), number_of_undecoded_spots."""
    cell = F.coalesce("cell_id", F.lit("unassigned")).alias("cell_id")
    middle = [(F.min(c) + (F.max(c) - F.min(c)) / 2).alias(c) for c in ("x", "y", "z", "xc", "yc", "zc") if c in decoded.columns]
    return decoded.groupBy(cell).agg(*middle, F.lit(None).cast("double").alias("area"), F.sum(F.col("target").isNull().cast("long")).alias("number_of_undecoded_spots"))


def expression_matrix(decoded: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """The wide matrix, a column per gene, 0 where a cell has none. genes: the columns, which saves a pass to find them.

    With genes, decoded is read once: features without a target are counted too, for the rows of cells that have no others.
    """
    if genes is not None:
        cell = F.coalesce("cell_id", F.lit("unassigned")).alias("cell_id")
        counts = decoded.groupBy(cell, F.col("target").alias("gene")).agg(F.count("*").alias("n"))
        return counts.groupBy("cell_id").pivot("gene", genes).agg(F.sum("n")).na.fill(0)
    wide = expression_long(decoded).groupBy("cell_id").pivot("gene").agg(F.sum("n"))
    every = decoded.select(F.coalesce("cell_id", F.lit("unassigned")).alias("cell_id")).distinct()
    return every.join(wide.hint("merge"), "cell_id", "left").na.fill(0)


def concatenate(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that one lacks are NULL."""
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def concatenate_expression(matrices: list[DataFrame]) -> DataFrame:
    """Wide matrices below each other; genes that one lacks are NULL there, not 0."""
    return concatenate(matrices)


def extents(features: DataFrame) -> DataFrame:
    """Bounding box of each field of view's features."""
    return features.groupBy("fov").agg(*(f(c).alias(f"{c}_{n}") for c in ("xc", "yc") for n, f in (("min", F.min), ("max", F.max))))


def overlaps(features: DataFrame) -> DataFrame:
    """Pairs (fov_a, fov_b) with fov_a < fov_b whose boxes touch or overlap, with the intersection.

    One box per field of view; boxes are spread over the strips of xc that they cover, a strip being
    as wide as the widest box, so the join is on strips and not on all pairs.
    """
    boxes = extents(features)
    width = boxes.agg(F.greatest(F.max(F.col("xc_max") - F.col("xc_min")), F.lit(1e-9)).alias("__w"))
    strip = lambda c: F.floor(F.col(c) / F.col("__w")).cast("long")
    spread = boxes.crossJoin(F.broadcast(width)).withColumn("__s", F.explode(F.sequence(strip("xc_min"), strip("xc_max")))).drop("__w")
    a, b = (spread.select("__s", *(F.col(c).alias(f"{c}_{s}") for c in boxes.columns)) for s in "ab")
    hit = (F.col("fov_a") < F.col("fov_b")) & (F.col("xc_max_a") >= F.col("xc_min_b")) & (F.col("xc_max_b") >= F.col("xc_min_a")) & (F.col("yc_max_a") >= F.col("yc_min_b")) & (F.col("yc_max_b") >= F.col("yc_min_a"))
    return _intersections(boxes, a.join(b, "__s").where(hit).select("fov_a", "fov_b").distinct())


def _intersections(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (fov_a, fov_b) those whose boxes touch or overlap, with the intersection."""
    a, b = (boxes.select(*(F.col(c).alias(f"{c}_{s}") for c in boxes.columns)) for s in "ab")
    inner = [f(F.col(f"{c}_{n}_a"), F.col(f"{c}_{n}_b")).alias(f"{c}_{n}") for c in ("xc", "yc") for n, f in (("min", F.greatest), ("max", F.least))]
    return pairs.join(a, "fov_a").join(b, "fov_b").select("fov_a", "fov_b", *inner).where("xc_min <= xc_max AND yc_min <= yc_max")


Area = dict[str, float | Column]


def sel_area(features: DataFrame, area: Area) -> DataFrame:
    """Features inside the area, its boundary included."""
    return features.where(F.col("xc").between(area["xc_min"], area["xc_max"]) & F.col("yc").between(area["yc_min"], area["yc_max"]))


def remove_area(features: DataFrame, area: Area) -> DataFrame:
    """Features outside the area; those on its boundary stay."""
    inside = (F.col("xc") > area["xc_min"]) & (F.col("xc") < area["xc_max"]) & (F.col("yc") > area["yc_min"]) & (F.col("yc") < area["yc_max"])
    return features.where(~inside)


def _trimmed(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """features without those that lose in the pairs' intersections: the table with more features there keeps them, the first if equal."""
    inside = F.col("xc").between(F.col("xc_min"), F.col("xc_max")) & F.col("yc").between(F.col("yc_min"), F.col("yc_max"))
    count = lambda s: pairs.join(features, pairs[f"fov_{s}"] == features["fov"]).where(inside).groupBy("fov_a", "fov_b").agg(F.count("*").alias(f"n_{s}"))
    judged = pairs.join(count("a"), ["fov_a", "fov_b"], "left").join(count("b"), ["fov_a", "fov_b"], "left").na.fill(0, ["n_a", "n_b"])
    loser = judged.select(F.when(F.col("n_a") >= F.col("n_b"), F.col("fov_b")).otherwise(F.col("fov_a")).alias("__fov"), *(F.col(c).alias(f"__{c}") for c in ("xc_min", "xc_max", "yc_min", "yc_max")))
    lost = (F.col("fov") == F.col("__fov")) & (F.col("xc") > F.col("__xc_min")) & (F.col("xc") < F.col("__xc_max")) & (F.col("yc") > F.col("__yc_min")) & (F.col("yc") < F.col("__yc_max"))
    return features.join(loser, lost, "left_anti")


def take_max_at_once(features: DataFrame) -> DataFrame:
    """take_max with all pairs judged on the untrimmed tables, in one plan. Equal to take_max where no feature lies in two intersections."""
    return _trimmed(features, overlaps(features))


def waves(pairs: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Pairs in order as waves: each pair comes after all earlier ones that share a field of view with it, and no two of a wave share one."""
    out: list[list[tuple[str, str]]] = []
    last: dict[str, int] = {}
    for a, b in pairs:
        n = max(last.get(a, 0), last.get(b, 0))
        if n == len(out):
            out.append([])
        out[n].append((a, b))
        last[a] = last[b] = n + 1
    return out


def take_max(features: DataFrame) -> DataFrame:
    """For each pair of overlapping fields of view, the one with more features in the intersection keeps them, the first if equal; the other loses those inside.

    Pairs come in order of (fov_a, fov_b), each judged on what earlier ones left, its boxes
    measured anew; a pair that no longer overlaps is passed over. Pairs that don't touch each
    other's tables are trimmed together, in one plan a wave; the driver holds the pairs, a few for
    each field of view.
    """
    pairs = [(p.fov_a, p.fov_b) for p in overlaps(features).select("fov_a", "fov_b").orderBy("fov_a", "fov_b").toLocalIterator()]
    for wave in waves(pairs):
        now = features.sparkSession.createDataFrame(wave, "fov_a string, fov_b string")
        features = cut(_trimmed(features, _intersections(extents(features), now)))
    return features


#: Strategies for overlapping fields of view by name.
OVERLAP_STRATEGIES = {"take_max": take_max, "take_max_at_once": take_max_at_once}


def concatenate_intensity_tables(tables: list[DataFrame], overlap_strategy: str | None = None) -> DataFrame:
    """All tables' rows; an overlap_strategy then settles overlapping fields of view."""
    both = concatenate(tables)
    if overlap_strategy is None:
        return both
    if overlap_strategy not in OVERLAP_STRATEGIES:
        raise ValueError(f"overlap strategy {overlap_strategy!r} is none of {sorted(OVERLAP_STRATEGIES)}")
    return OVERLAP_STRATEGIES[overlap_strategy](both)


def gene_correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pearson's r of two tables of counts (gene, n) over the genes that both have."""
    return left.select("gene", F.col("n").alias("a")).join(right.select("gene", F.col("n").alias("b")), "gene").agg(F.corr("a", "b").alias("r"), F.count("*").alias("genes"))


def top_genes(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent genes; equal counts in order of name."""
    return counts.orderBy(F.desc("n"), "gene").limit(k)
