"""Best-fit packing of token sequences by large-item matching.

Lengths are whole numbers up to the capacity, so the packing is planned on their histogram: at most
`capacity` counts, whatever the number of documents. Large pieces (over a third of the capacity)
are matched greedily, the longest with the longest partner that fits, at most two to a bin;
smaller ones, longest first, go where they leave the smallest gap. The plan says which bins the
n-th piece of each length goes to; n comes from counts per input partition, so no task or driver
ever holds the pieces of a length together.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CAPACITY = 2048
#: The id that ends each document.
END = 0


class Encoder:
    """The ids that the tokenizers library gives for a byte-level BPE file, worked out by tiktoken from the same file.

    Both apply the file's merges to the same pieces of text, lowest rank first; in these files a
    token's id is its rank. Where a text has an added token's characters, both give its id and
    encode what stands before and after it apart. The tests compare the two libraries' ids.
    """

    #: Splits text into the pieces within which byte-level BPE merges (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, vocab: dict[bytes, int], added: dict[str, int]) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=self.PATTERN, mergeable_ranks=vocab, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)


def byte_vocab(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(token bytes -> id, added token -> id) of a byte-level BPE file.

    The file writes bytes as printable characters: those that print stand for themselves, the
    others, in order, for the characters from U+0100 on.
    """
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    tokens = found.get("added_tokens", ())
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens of {path} that match more or less than their characters")
    added = {t["content"]: t["id"] for t in tokens}
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    char = {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(other)}
    return {bytes(char[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in added}, added


def _pieces(vocab: tuple[dict[bytes, int], dict[str, int]], capacity: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(*vocab), TaskContext.get().partitionId(), Counter()
        for b in parts:
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.ids(text or ""), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for n, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(doc_id)
                    piece.append(n)
                    start.append(i)
                    length.append(j - i)
                    crc.append(zlib.crc32(ids[i:j].tobytes()))
                    nth.append(seen[j - i])
                    seen[j - i] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in ((doc, pa.int64()), (piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), ([part] * len(doc), pa.int32()), (nth, pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with part (input partition) and nth (number among the part's pieces of that length)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(byte_vocab(tokenizer), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Histogram of lengths -> for each length the runs (first n, first bin, pieces per bin, offset) in order of n.

    Bins that hold the same lengths are one class, so the work depends on the number of lengths only.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    assert all(0 < n <= capacity for n in left)
    large = sorted(n for n in left if 3 * n > capacity)
    runs: dict[int, list] = {n: [] for n in left}
    used: dict[int, int] = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> classes of (first bin, number of bins)
    bins = 0

    def put(length: int, first: int, number: int, per_bin: int, offset: int) -> None:
        runs[length].append((used[length], first, per_bin, offset))
        used[length] += number * per_bin

    def open_bins(number: int) -> int:
        nonlocal bins
        bins += number
        return bins - number

    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] < 2:  # a single one can't be its own partner
            b = large[at - 1] if at > 0 else None
        pairs = 0 if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        if b is None:
            number = left[a]
            first, gap = open_bins(number), capacity - a
            put(a, first, number, 1, 0)
            left[a] = 0
        else:
            number = pairs
            first, gap = open_bins(number), capacity - a - b
            if a == b:
                put(a, first, number, 2, 0)
            else:
                put(a, first, number, 1, 0)
                put(b, first, number, 1, a)
            left[a] -= number
            left[b] -= number
        gaps.setdefault(gap, []).append((first, number))
        large = [n for n in large if left[n]]
    open_gaps = sorted(g for g in gaps if g)

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(open_gaps, s)
            if at == len(open_gaps):  # no gap is wide enough: new bins, each filled before the next
                per_bin = capacity // s
                number = left[s] // per_bin or 1
                gaps.setdefault(capacity, []).append((open_bins(number), number))
                open_gaps.append(capacity)
                continue
            g = open_gaps[at]
            first, number = gaps[g].pop()
            if not gaps[g]:
                del gaps[g]
                del open_gaps[at]
            per_bin = min(g // s, left[s])
            take = min(number, left[s] // per_bin)
            put(s, first, take, per_bin, capacity - g)
            left[s] -= take * per_bin
            rest = g - per_bin * s
            for gap, x, y in ((rest, first, take), (g, first + take, number - take)):
                if y and gap:
                    if gap not in gaps:
                        bisect.insort(open_gaps, gap)
                    gaps.setdefault(gap, []).append((x, y))
    return runs


def _placed(runs: dict[int, np.ndarray]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            length, n = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    size = int(length[rows[0]])
                    own = runs[size]
                    r = own[np.searchsorted(own[:, 0], n[rows], side="right") - 1]
                    k = n[rows] - r[:, 0]
                    sequence[rows] = r[:, 1] + k // r[:, 2]
                    offset[rows] = r[:, 3] + k % r[:, 2] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row of docs (columns doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then END, so a null or empty text is one piece of length 1. Longer
    ones than the capacity are cut from their end, so that only the first piece is shorter. A
    sequence holds pieces without gaps from offset 0. Repeated rows are packed each; rows without
    a doc_id too. An empty table gives no rows. tokenizer: path of a byte-level BPE file.
    """
    found = written(pieces(docs, tokenizer, capacity))
    counts = {r.length: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = {n: np.array(r, np.int64) for n, r in plan(counts, capacity).items()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    numbered = found.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("n"))
    return numbered.mapInArrow(_placed(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
