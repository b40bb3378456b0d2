"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint's 64 bits form a ring of M = 4 segments. If two fingerprints differ in at most
T = 3 bits, some chain of consecutive segments starts so that for every length l its first l
segments differ in at most l*T/M bits in all: 0, 1, 2, 3 (Qin and Xiao, Pigeonring). Candidates
share a key that this needs: one segment equal and, of the next one, in which at most one bit may
differ, one of its halves. The chain's budgets prune candidates before the full Hamming check.
Keys with more than BUCKET fingerprints get longer keys: the bits that aren't in the key hold at
most T differences, so of T+1 parts of them one is equal; this repeats until buckets are small.
A bucket gives links that span its components instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, id_and_text, written
from .components import components

T, M, BITS = 3, 4, 64
WIDTH = BITS // M
#: Fingerprints of a key that are compared with each other without splitting it further.
BUCKET = 2048


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    joined = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    n = len(starts)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 65_536):
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[k : k + 65_536], stops[k : k + 65_536], strict=True)), np.uint64, min(65_536, n - k))
        ones += _bit_counts(h)
    return int(np.packbits((2 * ones > n)[::-1]).view(">u8")[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of h have bit 0, 1, ... 63 set."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _fingerprints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        fp = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], names=["doc_id", "fp", "th"])


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp as a signed long, th: a hash of the text), one row per row of docs."""
    return id_and_text(docs.select("doc_id", "text", _text_hash().alias("th")), "th").mapInArrow(_fingerprints, "doc_id long, fp long, th long")


def keys() -> list[tuple[int, int, int]]:
    """(segment, half, mask of the key's bits) for each of the 2*M keys of a fingerprint."""
    whole, half = (1 << WIDTH) - 1, (1 << WIDTH // 2) - 1
    return [(i, j, whole << i * WIDTH | half << ((i + 1) % M * WIDTH + j * WIDTH // 2)) for i in range(M) for j in (0, 1)]


def viable(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether differences x keep a chain's budgets: of the segments from start on, the first l hold at most l * T / M bits, for every l. No chain: start -1."""
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.uint8)
    for step in range(M):
        at = ((np.maximum(start, 0) + step) % M * WIDTH).astype(np.uint64)
        total += np.bitwise_count(x >> at & np.uint64((1 << WIDTH) - 1))
        ok &= (start < 0) | (total <= (step + 1) * T // M)
    return ok


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs survive the chain's budgets and then the full Hamming check."""
    x = a ^ b
    ok = viable(x, start)
    ok[ok] = np.bitwise_count(x[ok]) <= T
    return ok


def _spans(fps: np.ndarray, start: int, free: int, bucket: int) -> list[tuple[int, int]]:
    """Links among distinct fingerprints that share all bits but those of free; they span what is linked there."""
    if len(fps) < 2:
        return []
    if len(fps) > bucket and free:
        bits = [i for i in range(BITS) if free >> i & 1]
        found = []
        for part in np.array_split(bits, T + 1):
            mask = sum(1 << int(i) for i in part)
            group = fps & np.uint64(mask)
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            for g in np.split(fps[order], cuts):
                found += _spans(g, start, free & ~mask, bucket)
        return found
    root = np.arange(len(fps))
    found = []
    starts = np.full(len(fps), start)
    for i in range(len(fps) - 1):
        j = np.flatnonzero(_linked(fps[i + 1 :], fps[i], starts[i + 1 :])) + i + 1
        groups, at = np.unique(root[j], return_index=True)  # one link to each group is enough
        at = j[at[groups != root[i]]]
        if len(at):
            found += [(int(fps[i]), int(fps[k])) for k in at]
            joined = np.append(root[at], root[i])
            root[np.isin(root, joined)] = joined.min()
    return found


def _links(bucket: int, masks: list[tuple[int, int]]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in parts if b.num_rows]):
            return
        held = pa.Table.from_batches(held)
        key, fp = (c.to_numpy().view(np.uint64) for c in held.columns)
        order = np.argsort(key)
        key, fp = key[order], fp[order]
        k = (key >> np.uint64(KEY_BITS)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        # Rows linked to the first one of their key need no more comparing if that holds for all of the key.
        sizes = np.diff(cuts)
        run = np.repeat(np.arange(len(sizes)), sizes)
        rest = np.ones(len(k), bool)
        rest[cuts[:-1]] = False
        rest = np.flatnonzero(rest)
        first = cuts[:-1][run[rest]]
        starts = np.array([m[0] for m in masks])[k % len(masks)]
        near = _linked(fp[rest], fp[first], starts[rest])
        far = np.zeros(len(sizes), bool)
        np.logical_or.at(far, run[rest[~near]], True)
        far &= sizes > 2
        star = near & ~far[run[rest]]
        out = []
        for c in np.flatnonzero(far):
            a, b = cuts[c], cuts[c + 1]
            start, mask = masks[k[a] % len(masks)]
            extra = 0 if k[a] < len(masks) else _extra(mask)[k[a] // len(masks) - 1]
            out += _spans(fp[a:b], start, ~(mask | extra) & ((1 << BITS) - 1), bucket)
        links = np.concatenate([np.stack([fp[first[star]], fp[rest[star]]], axis=1), np.array(out, np.uint64).reshape(-1, 2)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    return run


def _extra(mask: int) -> list[int]:
    """T+1 parts of the bits that a key leaves out, as masks; one of them is equal in linked fingerprints."""
    bits = [i for i in range(BITS) if not mask >> i & 1]
    return [sum(1 << int(i) for i in part) for part in np.array_split(bits, T + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


#: A key's low bits are those of the fingerprint, pushed together; above them is the number of its mask.
KEY_BITS = 58


def _key(number: int, mask: int) -> Column:
    at, out = 0, F.lit(_signed(number << KEY_BITS))
    while mask:
        start = (mask & -mask).bit_length() - 1
        run = mask >> start
        size = (~run & (run + 1)).bit_length() - 1
        bits = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << size) - 1))
        out = out.bitwiseOR(F.shiftleft(bits, at))
        at += size
        mask &= ~(((1 << size) - 1) << start)
    return out


def key_rows(masks: list[tuple[int, int]]) -> Column:
    """The fingerprint's key for each mask, as an array of longs."""
    return F.array(*(_key(n, m) for n, (_, m) in enumerate(masks)))


#: Bits by which keys are counted roughly.
ROUGH = 13


def _hot_keys(distinct: DataFrame, rows: DataFrame, masks: list[tuple[int, int]], bucket: int) -> DataFrame | None:
    """(key, hot): keys that hold more rows than bucket and than a task should, refined before any task has to hold them.

    A key holds no more rows than its lowest ROUGH bits do. These are counted first, in cells of
    which there are a few thousand per mask, and before the shuffle; keys are counted exactly only
    below cells that hold far more than others.
    """
    low = {}
    for n, (_, m) in enumerate(masks):
        bits, part = [i for i in range(BITS) if m >> i & 1][:ROUGH], 0
        for i in bits:
            part |= 1 << i
        low.setdefault(part, []).append(n)
    parts = list(low)
    cells = distinct.select(F.explode(F.array(*(_key(i, p) for i, p in enumerate(parts)))).alias("cell")).groupBy("cell").count().toArrow()
    n = cells["count"].to_numpy()
    limit = max(bucket, 4 * int(n.sum()) // (len(parts) << ROUGH))
    full = cells["cell"].to_numpy()[n > limit].view(np.uint64)
    if not len(full):
        return None
    hot = F.lit(False)
    for i, part in enumerate(parts):
        own = (full[full >> np.uint64(KEY_BITS) == i] & np.uint64((1 << KEY_BITS) - 1)).tolist()
        if own:
            size = part.bit_count()
            mine = F.shiftrightunsigned("key", KEY_BITS).isin(low[part])
            hot = hot | mine & F.col("key").bitwiseAND(F.lit((1 << size) - 1)).isin(own)
    found = written(rows.where(hot).groupBy("key").count().where(F.col("count") > bucket).select("key", F.lit(True).alias("hot")))
    return found if found.limit(1).count() else None


def links(distinct: DataFrame, bucket: int = BUCKET, masks: list[tuple[int, int]] | None = None) -> DataFrame:
    """(u, v): links among the distinct fingerprints in column fp that connect all that differ in at most T bits.

    masks: (first segment of the chain to check or -1, bits) of keys of which linked fingerprints share one.
    """
    masks = masks or [(i, m) for i, _, m in keys()]
    rows = distinct.select(F.explode(key_rows(masks)).alias("key"), "fp")
    hot = _hot_keys(distinct, rows, masks, bucket)
    if hot is not None:
        longer = F.lit(None)
        for n, (_, m) in enumerate(masks):
            parts = F.array(*(_key(n + len(masks) * (e + 1), m | x) for e, x in enumerate(_extra(m))))
            longer = F.when(F.shiftrightunsigned("key", KEY_BITS) == n, parts).otherwise(longer)
        rows = rows.join(hot, "key", "left").select(F.explode(F.when(F.col("hot"), longer).otherwise(F.array("key"))).alias("key"), "fp")
    return rows.repartition("key").mapInArrow(_links(bucket, masks), "u long, v long")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs (columns doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Words are split at [\\x20\\x09-\\x0D] after lower-casing A-Z; 3-word shingles, repeats
    included; a text of one to three words is one shingle; a null, empty or blank text has
    fingerprint zero and is linked like any other. component_id is the smallest doc_id among the
    documents that links of at most 3 differing bits reach; rows without a doc_id take part but
    never name a component (one of only such rows has null). Repeated rows share fingerprint and
    component. No pair of equal fingerprints is made: links join distinct fingerprints only.
    """
    return _members(docs, bucket).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(docs: DataFrame, bucket: int) -> DataFrame:
    """(doc_id, fp, th, component_id) of each row."""
    fp = written(fingerprints(docs))
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, bucket))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", "fp", "th", "component_id")


def one_of_each(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with its smallest doc_id stays, with all columns.

    Rows without a doc_id stay, as no other row can stand for them; of rows that share the
    component's doc_id all stay: run exact dedup first. Rows of one doc_id and unlike texts are
    told apart by their texts. Clashing column names are untouched.
    """
    drop = _members(docs, bucket).where("doc_id <> component_id").select("doc_id", "th").distinct()
    drop = drop.toDF(*("_" * (1 + max(map(len, docs.columns))) + c for c in drop.columns))  # longer than any name of docs
    return docs.join(drop, (docs["doc_id"] == drop[0]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == drop[1]), "left_anti")
