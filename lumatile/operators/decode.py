"""Decoding traces against a codebook. A codebook is an experiment's design, a few thousand codes; its size is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import chunks, clean, distance, first_argmax, norm, normalised
from .traces import build_traces, checked, physical_coords

#: Codes that are broadcast at once; a larger codebook is joined by a shuffle, or compared in several steps.
BROADCAST_CODES = 100_000


def _spread(codes: DataFrame) -> DataFrame:
    return F.broadcast(codes) if codes.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES else codes


def normalize_features(features: DataFrame, size: int, order: float = 2, column: str = "trace") -> DataFrame:
    """The column divided by its norm, with the norm as column `norm`. A trace of zeros becomes an even one."""
    a = F.col(column)
    return features.withColumn("norm", norm(a, order)).withColumn(column, normalised(a, order, size))


def nearest_code(features: DataFrame, codes: DataFrame, metric: str = "euclidean") -> DataFrame:
    """features with code_idx, target and distance of the nearest code; of equally near ones (to 12 places) the first.

    Every trace is compared with every code, and traces are not shuffled. BROADCAST_CODES codes at a
    time are broadcast, and larger codebooks take several such steps. Distances that come from
    products are worked out for a batch of traces at once, others within the row.
    """
    count = codes.limit(BROADCAST_CODES + 1).count()
    n = 1 if count <= BROADCAST_CODES else -(-codes.count() // BROADCAST_CODES)
    block = lambda i: codes if n == 1 else codes.where(F.pmod(F.xxhash64("code_idx"), F.lit(n)) == i)
    out = features.withColumn("__best", F.lit(None).cast("struct<d:double,i:int,t:string>"))
    for i in range(n):
        out = (_nearest_by_product if metric in PRODUCTS else _nearest_in_row)(out, block(i), metric)
    return out.withColumns({"code_idx": F.col("__best.i"), "target": F.col("__best.t"), "distance": F.col("__best.d")}).drop("__best")


def _nearest_in_row(features: DataFrame, codes: DataFrame, metric: str) -> DataFrame:
    far = lambda k: F.struct(F.round(distance(F.col("trace"), k["code"], metric), 12).alias("d"), k["code_idx"].cast("int").alias("i"), k["target"].alias("t"))
    book = codes.select("code_idx", "target", F.col("trace").alias("code")).agg(F.collect_list(F.struct("code_idx", "target", "code")).alias("__book"))
    best = F.array_min(F.transform("__book", far))
    return features.crossJoin(F.broadcast(book)).withColumn("__best", F.least("__best", best)).drop("__book")


#: Metrics that a product of two matrices nearly gives, and how near: what is nearer than that is worked out exactly.
PRODUCTS, SLACK = ("euclidean", "sqeuclidean", "cosine"), 1e-9
#: Numbers of one product.
PRODUCT = 1 << 22


def _nearest_by_product(features: DataFrame, codes: DataFrame, metric: str) -> DataFrame:
    rows = codes.select(F.col("code_idx").cast("int"), "target", "trace").orderBy("code_idx").collect()  # BROADCAST_CODES at most
    if not rows:
        return features
    book = features.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], float)))
    at, best_at = features.columns.index("trace"), features.columns.index("__best")

    def exact(u: np.ndarray, k: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                return 1 - (u * k).sum(axis=-1) / (np.sqrt((u * u).sum(axis=-1)) * np.sqrt((k * k).sum(axis=-1)))
        square = ((u - k) ** 2).sum(axis=-1)
        return square if metric == "sqeuclidean" else np.sqrt(square)

    def nearest(u: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nearest codes and their distances; NaN, where a vector of zeros has no angle, is nearer than all."""
        if metric == "cosine":
            unit = lambda v: v / np.sqrt((v * v).sum(axis=1, keepdims=True))
            with np.errstate(invalid="ignore"):
                near = -unit(u) @ unit(code).T
        else:
            near = (code * code).sum(axis=1) - 2 * (u @ code.T)
        place = near.argmin(axis=1)
        d = np.round(exact(u, code[place]), 12)
        limit = near[np.arange(len(u)), place] + SLACK * (1 + np.abs(near).max(axis=1))
        for r in np.flatnonzero((near <= limit[:, None]).sum(axis=1) > 1):
            k = np.flatnonzero(near[r] <= limit[r])
            own = np.round(exact(u[r], code[k]), 12)
            place[r], d[r] = k[own.argmin()], own.min()
        return place, d

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, target, code = book.value
        step = max(1, PRODUCT // len(code))
        for b in parts:
            held = b.column(best_at).to_pylist()
            traces = b.column(at)
            size = traces.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            if len(size) and (wrong := size[(size >= 0) & (size != code.shape[1])]).size:
                raise ValueError(f"a trace of {wrong[0]} values, codes of {code.shape[1]}")
            on = np.flatnonzero(size >= 0)
            u = traces.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, code.shape[1])
            for a in range(0, len(on), step):
                place, d = nearest(u[a : a + step], code)
                for r, k, x in zip(on[a : a + step].tolist(), place.tolist(), d.tolist(), strict=True):
                    x = None if x != x else x
                    was = held[r]
                    if was is None or (x is not None, x or 0.0, index[k]) < (was["d"] is not None, was["d"] or 0.0, was["i"]):
                        held[r] = {"d": x, "i": index[k], "t": target[k]}
            yield b.set_column(best_at, b.schema.field(best_at), pa.array(held, b.schema.field(best_at).type))

    return features.mapInArrow(run, features.schema)


def decode_metric(features: DataFrame, codes: DataFrame, size: int, max_distance: float, min_intensity: float, norm_order: float = 2, metric: str = "euclidean", return_original_intensities: bool = False, even_zeros: bool = True) -> DataFrame:
    """Nearest code of the normalised trace. A target is always named; it passes if norm >= min_intensity and distance <= max_distance.

    NULL and NaN cells count as 0 for the norm. even_zeros: a trace of zeros is compared as an even one;
    otherwise as zeros, which are as far from every code.
    """
    features, codes = checked(features, size, 1), checked(codes, size, 1)
    kept = features.withColumn("__trace", F.col("trace")).withColumn("trace", clean(F.col("trace")))
    unit = normalize_features(kept, size, norm_order)
    if not even_zeros:
        unit = unit.withColumn("trace", F.when(F.col("norm") == 0, F.array_repeat(F.lit(0.0), size)).otherwise(F.col("trace")))
    book = normalize_features(codes.select("code_idx", "target", clean(F.col("trace")).alias("trace")), size, norm_order).drop("norm")
    out = nearest_code(unit, book, metric).withColumn("passes_thresholds", (F.col("norm") >= min_intensity) & (F.col("distance") <= max_distance))
    return (out.withColumn("trace", F.col("__trace")) if return_original_intensities else out).drop("__trace", "norm")


def _pattern(trace: Column, rounds: int, channels: int) -> Column:
    """The first largest channel of each round; `channels` for a round without contrast."""
    return F.transform(chunks(trace, rounds, channels), lambda r: F.when(F.array_max(r) == F.array_min(r), F.lit(channels)).otherwise(first_argmax(r)))


def decode_per_round_max(features: DataFrame, codes: DataFrame, rounds: int, channels: int) -> DataFrame:
    """Match the largest channel of every round with the codes' own; a hash join on the pattern.

    A round of equal values matches nothing, so with one channel nothing decodes. Of equal codes the
    last one counts. distance is 1 - the mean over rounds of largest / sum, rounds of zeros skipped.
    A codeword's round without any signal stands for channel 0.
    """
    features, codes = checked(features, rounds, channels), checked(codes, rounds, channels)
    rows = F.transform(chunks(clean(F.col("trace")), rounds, channels), lambda r: F.struct(F.array_max(r).alias("m"), F.aggregate(r, F.lit(0.0), lambda s, v: s + v).alias("s")))
    good = F.filter(rows, lambda x: x["s"] != 0)
    share = F.try_divide(F.aggregate(good, F.lit(0.0), lambda s, x: s + x["m"] / x["s"]), F.size(good))
    own = F.transform(chunks(clean(F.col("trace")), rounds, channels), lambda r: first_argmax(r))
    book = codes.select(own.alias("__p"), "code_idx", "target").groupBy("__p").agg(F.max_by("target", "code_idx").alias("target"))
    out = features.withColumn("__p", _pattern(clean(F.col("trace")), rounds, channels)).join(_spread(book), "__p", "left").drop("__p")
    return out.withColumns({"distance": F.lit(1.0) - share, "passes_thresholds": F.col("target").isNotNull()})


def simple_lookup(spots: DataFrame, code_cells: DataFrame) -> DataFrame:
    """Spots with the target of their (r, c); code_cells has code_idx, target, r, c; of several codes the last counts. NULL where none."""
    book = code_cells.groupBy("r", "c").agg(F.max_by("target", "code_idx").alias("target"))
    return spots.join(_spread(book), ["r", "c"], "left")


def metric_distance(spots: DataFrame, codes: DataFrame, rounds: int, channels: int, max_distance: float, min_intensity: float, norm_order: float = 2, metric: str = "euclidean", trace_building_strategy: str = "exact_match", anchor_round: int = 1, search_radius: float = 3, return_original_intensities: bool = False, ticks: DataFrame | None = None, even_zeros: bool = True) -> DataFrame:
    """Spots to traces to decoded features, with physical coordinates if ticks are given."""
    traces = build_traces(spots, trace_building_strategy, rounds, channels, anchor_round=anchor_round, search_radius=search_radius)
    traces = traces if ticks is None else physical_coords(traces, ticks)
    return decode_metric(traces, codes, rounds * channels, max_distance, min_intensity, norm_order, metric, return_original_intensities, even_zeros)


def per_round_max_channel(spots: DataFrame, codes: DataFrame, rounds: int, channels: int, trace_building_strategy: str = "exact_match", anchor_round: int = 1, search_radius: float = 3, ticks: DataFrame | None = None) -> DataFrame:
    """Spots to traces to features decoded by the largest channel per round."""
    traces = build_traces(spots, trace_building_strategy, rounds, channels, anchor_round=anchor_round, search_radius=search_radius)
    traces = traces if ticks is None else physical_coords(traces, ticks)
    return decode_per_round_max(traces, codes, rounds, channels)
