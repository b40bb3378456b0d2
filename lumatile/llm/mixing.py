"""Mixing sources to target weights by Sainte-Laguë apportionment.

Documents fall into shards by a hash of their key. A source is spread over as many shards as it
has pieces of PIECE blocks, up to all: hot ones are everywhere, and rare ones stay together, as
each shard rounds quotas to blocks on its own. In each shard the sources' words are cut into blocks of as many tokens; the
shard's blocks go to sources one by one, each to the highest quotient share / (2 * quota + 1);
then a seeded choice takes a source's quota: all its blocks as often as they fit, and from a
seeded place on as many blocks in a row as remain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written

#: Weights of the sources in order, repeating (fixed values), the share of all words that is taken, and how often a source's words are taken at most.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words of a block and, about, of a shard.
BLOCK, SHARD = 64, 1_000_000
#: Blocks that a source has at least, about, in each shard that it is spread over.
PIECE = 256
#: Columns that a shard has before those of its rows.
SHARDED = ("doc_id", "source", "size", "hash", "place", "shard", "rank", "source_size", "target")
OWN = len(SHARDED)
#: Up to so many sources, their table is worked out on the driver and broadcast; beyond, Spark works out the same one and joins it.
FEW_SOURCES = 100_000


def _sizes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        texts = b.column(1).to_pylist()
        n = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
        h = np.fromiter((xxhash.xxh3_64_intdigest(t) >> 1 for t in texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(h)], names=["doc_id", "source", "size", "hash"])


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> dict[str | None, float]:
    """Each source's target in words: by weight, at most `repeats` times its size, the excess shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, out = share * sum(sizes.values()), {}
    free = sorted(order, key=lambda s: repeats * sizes[s] / weight[s])
    sum_w = sum(weight.values())
    for s in free:  # in the order in which their limits are reached
        out[s] = min(float(repeats * sizes[s]), total * weight[s] / sum_w)
        total -= out[s]
        sum_w -= weight[s]
    return out


def apportion(shares: np.ndarray, blocks: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: `blocks` to shares by highest quotient share / (2k + 1), none above `most`; ties go to the first.

    Starts from quotas that are certain, so that only about twice as many blocks as there are
    shares are given one by one.
    """
    quota = np.zeros(len(shares), np.int64)
    total = shares.sum()
    if total <= 0 or blocks <= 0:
        return quota
    # A divisor d that gives sum(round(shares / d)) = blocks is at most total / (blocks - n / 2).
    sure = np.ceil(shares * max(0.0, blocks - len(shares) / 2) / total - 0.5).astype(np.int64) - 1
    quota = np.minimum(np.maximum(sure, 0), most)
    while quota.sum() < blocks and (open_ := (quota < most) & (shares > 0)).any():
        quota[np.argmax(np.where(open_, shares / (2 * quota + 1), -1.0))] += 1
    return quota


def _chooser(seed: int, block: int, repeats: float):
    """A function of a shard's table: its rows' order, sizes, words taken and spans (epoch, first, last)."""

    def choose(group: pa.Table) -> tuple:
        by = np.lexsort([group[c].to_numpy() for c in ("hash", "place", "rank")])  # whatever the order of the rows was
        rank, place, size, target, of = (group[c].to_numpy()[by] for c in ("rank", "place", "size", "target", "source_size"))
        ranks, starts = np.unique(rank, return_index=True)
        stops = np.append(starts[1:], len(by))
        words = np.add.reduceat(size, starts)
        want = target[starts] * words / np.maximum(1, of[starts])
        names = group["source"].take(pa.array(by[starts])).to_pylist()
        blocks = -(-words // block)
        quota = apportion(want, int(round(want.sum() / block)), np.minimum(np.ceil(repeats * words / block), repeats * blocks).astype(np.int64))
        taken, spans = np.zeros(len(by), np.int64), [[] for _ in by]
        for name, a, b, w, n, q in zip(names, starts, stops, words, blocks, quota, strict=True):
            if not q:
                continue
            end = np.cumsum(size[a:b])
            begin = end - size[a:b]
            full, rest = divmod(int(q), int(n))
            # The seed and what the shard holds of the source place the run of blocks for the rest.
            at = xxhash.xxh3_64_intdigest(f"{seed}:{name}:{place[a]}".encode()) % int(n)
            runs = [(e, 0, w) for e in range(full)]
            if rest:
                runs.append((full, at * block, min((at + rest) * block, w)))
            if at + rest > n:
                runs.append((full, 0, (at + rest - n) * block))
            for epoch, lo, hi in runs:
                x, y = np.maximum(begin, lo) - begin, np.minimum(end, hi) - begin
                for i in np.flatnonzero(y > x):
                    taken[a + i] += y[i] - x[i]
                    spans[a + i].append({"epoch": epoch, "first": int(x[i]), "last": int(y[i])})
        return by, size, taken, spans

    return choose


def _shard(choose):
    kind = pa.list_(pa.struct([("epoch", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(group: pa.Table) -> pa.Table:
        by, size, taken, spans = choose(group)
        own = {c: group[c].take(pa.array(by)) for c in ("doc_id", "source", "source_size", "target")}
        return pa.table({"doc_id": own["doc_id"], "source": own["source"], "size": size, "source_size": own["source_size"], "target": own["target"], "taken": taken, "spans": pa.array(spans, kind)})

    return run


def _cut(text: str, size: int, spans: list[tuple[int, int]]) -> str:
    """The words of the spans, with what stands between them in the text; spans are joined by a line break."""
    if spans == [(0, size)]:
        return text
    raw = text.encode()
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    return b"\n".join(raw[words[i][0] : words[j - 1][1]] for i, j in spans).decode()


def _taken_rows(choose, names: list[str], schema: pa.Schema):
    text_at = names.index("text")

    def run(group: pa.Table) -> pa.Table:
        # The shard's own columns come first; the row's columns follow by position, whatever their names are.
        by, size, _, spans = choose(group)
        rows, texts = [], []
        texts_in = group.column(OWN + text_at)
        for i, n, found in zip(by, size, spans, strict=True):
            for epoch in sorted({s["epoch"] for s in found}):
                rows.append(i)
                texts.append(_cut(texts_in[int(i)].as_py(), int(n), sorted((s["first"], s["last"]) for s in found if s["epoch"] == epoch)))
        columns = [group.column(OWN + k).take(pa.array(rows, pa.int64())) for k in range(len(names))]
        columns[text_at] = pa.chunked_array([pa.array(texts, pa.string())])
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _measured(names: list[str]):
    text_at = names.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = [(t or "").encode() for t in b.column(text_at).to_pylist()]
            n = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
            h = np.fromiter((xxhash.xxh3_64_intdigest(t) >> 1 for t in texts), np.int64, len(texts))
            ids, source = b.column(names.index("doc_id")).cast(pa.int64()), b.column(names.index("source")).cast(pa.string())
            own = [ids, source, pa.array(n), pa.array(h)]
            yield pa.RecordBatch.from_arrays([*own, *b.columns], names=[f"c{i}" for i in range(4 + len(names))])

    return run


def _sizes_of(docs: DataFrame) -> DataFrame:
    rows = id_and_text(docs, "source").select("doc_id", "text", F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(_sizes, "doc_id long, source string, size long, hash long")


def _sources(sizes: DataFrame, weights: tuple, share: float, repeats: float, few: int = FEW_SOURCES) -> tuple[DataFrame, int]:
    """((source, rank, source_size, target), all words). Ranks go by code point, null last."""
    spark = sizes.sparkSession
    by_source = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = by_source.agg(F.sum("source_size")).first()[0] or 0
    if by_source.limit(few + 1).count() <= few:
        size_of = {r["source"]: r["source_size"] for r in by_source.collect()}
        target_of = targets(size_of, weights, share, repeats)
        names = sorted(size_of, key=lambda s: (s is None, s or ""))
        return F.broadcast(spark.createDataFrame([(s, i, size_of[s], target_of[s]) for i, s in enumerate(names)], "source string, rank long, source_size long, target double")), total
    # A sort's row numbers from counts per partition, then the level at which sources are full, by rounds of two sums.
    order = (F.col("source").isNull(), F.col("source"))
    placed = by_source.repartitionByRange(*order).sortWithinPartitions(*order).select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    placed = written(placed)
    before, table = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row per partition
        table.append((r["part"], before))
        before += r["count"]
    ranked = placed.join(F.broadcast(spark.createDataFrame(table, "part int, base long")), "part").withColumn("rank", F.col("base") + F.col("nth"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "rank", "source_size", weight.alias("weight"), (F.col("source_size") * float(repeats)).alias("most"))
    level, full = 0.0, -1
    while True:
        n, held, open_ = ranked.agg(F.count_if(F.col("most") <= level * F.col("weight")), F.coalesce(F.sum(F.when(F.col("most") <= level * F.col("weight"), F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("most") > level * F.col("weight"), F.col("weight"))), F.lit(0.0))).first()
        if n == full or not open_:
            break
        full, level = n, (share * total - held) / open_
    return ranked.select("source", "rank", "source_size", F.least("most", level * F.col("weight")).alias("target")), total


def _place(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", "hash")


def _sharded(placed: DataFrame, sources: DataFrame, shards: int, block: int) -> DataFrame:
    """placed (columns source, place) with the columns of sources and shard."""
    of = sources.withColumnRenamed("source", "of")
    own = placed.join(of, placed["source"].eqNullSafe(of["of"]))  # of hot sources' rows Spark splits, if it doesn't broadcast
    spread = F.least(F.lit(shards), F.greatest(F.lit(1), F.floor(F.col("source_size") / (PIECE * block))))
    first = F.xxhash64(F.lit("shard"), "source")  # rare sources begin at different shards
    return own.withColumn("shard", F.pmod(F.pmod(first, F.lit(shards)) + F.pmod("place", spread), F.lit(shards))).drop("of")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """One row per row of docs (columns doc_id, text, source): doc_id, source, size, source_size, target, taken, spans.

    size: words of the text (null: 0). target: the source's, in words; a null source is a source
    of its own, last in order. taken: words that the mix takes of the row, at most `repeats` *
    size. spans: the taken words as (epoch, first, last), last exclusive. A source without words
    has target 0. Repeated rows are rows of their own and may be taken unlike each other. An
    empty table gives no rows. Reruns agree, in whatever order the rows are read.
    """
    sizes = written(_sizes_of(docs))
    sources, total = _sources(sizes, weights, share, repeats)
    placed = _sharded(sizes.withColumn("place", _place(seed)), sources, max(1, round(total / shard)), block)
    return placed.select(*SHARDED).groupBy("shard").applyInArrow(
        _shard(_chooser(seed, block, repeats)),
        "doc_id long, source string, size long, source_size long, target double, taken long, spans array<struct<epoch:int,first:long,last:long>>",
    )


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """The mix itself: a row of docs for each time that words of it are taken, with the text cut to these words.

    Chooses as mix() does. A row taken whole keeps its text as it is; of one that a run of blocks
    enters or leaves, the words in the run stay. Rows without words or that aren't taken are left
    out. All columns are kept, whatever their names are; only text changes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    sources, total = _sources(_sizes_of(docs), weights, share, repeats)
    schema = StructType().add("doc_id", LongType()).add("source", StringType()).add("size", LongType()).add("hash", LongType())
    for i, field in enumerate(docs.schema.fields):
        schema = schema.add(f"col{i}", field.dataType)
    rows = _sharded(docs.mapInArrow(_measured(docs.columns), schema).withColumn("place", _place(seed)), sources, max(1, round(total / shard)), block)
    rows = rows.select(*SHARDED, *(f"col{i}" for i in range(len(docs.columns))))
    return rows.groupBy("shard").applyInArrow(_taken_rows(_chooser(seed, block, repeats), docs.columns, to_arrow_schema(docs.schema)), docs.schema)
