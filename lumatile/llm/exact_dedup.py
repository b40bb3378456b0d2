"""Exact dedup by Grace hashing.

Two rounds of the same streaming table. Round one runs where the rows are read and leaves one
representative for each distinct content of an input partition, so a group of copies of any size
sends one row per partition into the shuffle. Round two runs after a shuffle by content hash.
Each round keeps an open-addressing table of complete contents up to a byte budget; once that is
full, rows whose content isn't in it go to spill files by hash, and each file is treated alike
with another seed. Copies never meet in one task: they get their result through a join on their
partition's representative.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, batches, id_and_text, written

#: Bytes of distinct content that one table holds before it spills.
TABLE_BYTES = 64 << 20
#: Spill files of one level.
FAN_OUT = 16
#: Partition number and row number make a row's key: 2**36 rows a partition.
ROW_BITS = 36


class OpenTable:
    """Open addressing with linear probing; a slot matches on its hash and then on the complete content."""

    def __init__(self) -> None:
        self.slots = [0] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []
        self.size = 0

    def find(self, h: int, content: bytes) -> tuple[int, list | None]:
        """The slot for content and its value, or None if the slot is free."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) and not (self.hashes[k - 1] == h and self.contents[k - 1] == content):
            at = (at + 1) & mask
        return at, self.values[k - 1] if k else None

    def put(self, at: int, h: int, content: bytes, value: list) -> None:
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.slots[at] = len(self.values)
        self.size += len(content) + 200
        if 2 * len(self.values) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [0] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes, 1):
            at = h & mask
            while self.slots[at]:
                at = (at + 1) & mask
            self.slots[at] = k


def grace(rows: Iterable[tuple[bytes, object]], start, merge, table_bytes: int, folder: str, level: int = 0) -> Iterator[tuple]:
    """Group rows of (content, item) by content.

    start(item) gives a group's value; merge(value, item) adds one and may return a row to pass
    on at once. Yields ("row", row) for those and ("group", content, value) for each group.
    """
    table, files, used = OpenTable(), None, [0] * FAN_OUT
    for content, item in rows:
        h = xxhash.xxh3_64_intdigest(content, seed=level)
        at, value = table.find(h, content)
        if value is not None:
            if (row := merge(value, item)) is not None:
                yield "row", row
        elif files is None and table.size < table_bytes:
            table.put(at, h, content, start(item))
        else:
            if files is None:
                files = [tempfile.TemporaryFile(dir=folder) for _ in range(FAN_OUT)]
            k = (h >> 59) % FAN_OUT
            pickle.dump((content, item), files[k], protocol=5)
            used[k] += 1
    for content, value in zip(table.contents, table.values, strict=True):
        yield "group", content, value
    del table
    for k, f in enumerate(files or ()):
        if used[k]:
            f.seek(0)
            yield from grace((pickle.load(f) for _ in range(used[k])), start, merge, table_bytes, folder, level + 1)
        f.close()


def better(a: tuple, b: tuple) -> bool:
    """Whether row a=(n_chars, doc_id, uid) stays rather than b: most characters, then smallest doc_id (null last), then first read."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


LOCAL = pa.schema([("uid", pa.int64()), ("rep_uid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("text", pa.binary()), ("best_chars", pa.int64()), ("best_doc", pa.int64()), ("best_uid", pa.int64()), ("n", pa.int64())])
GROUPS = pa.schema([("rep_uid", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
LOCAL_SQL = "uid long, rep_uid long, doc_id long, part long, text binary, best_chars long, best_doc long, best_uid long, n long"
GROUPS_SQL = "rep_uid long, keep_id long, keep_uid long, group_size long, text_sha256 string"


def _local(table_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << ROW_BITS

        def rows():
            uid = base
            for b in parts:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n_chars = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
                    yield text.translate(None, SPACES), (uid, doc_id, n_chars)
                    uid += 1

        def start(item):
            uid, doc_id, n_chars = item
            return [uid, doc_id, (n_chars, doc_id, uid), 1]

        def merge(value, item):
            uid, doc_id, n_chars = item
            value[3] += 1
            if better(mine := (n_chars, doc_id, uid), value[2]):
                value[2] = mine
            return uid, value[0], doc_id, None, None, None, None, None, None

        def out():
            with tempfile.TemporaryDirectory() as folder:
                for kind, *x in grace(rows(), start, merge, table_bytes, folder):
                    if kind == "row":
                        yield x[0]
                    else:
                        content, (uid, doc_id, best, n) = x
                        yield uid, uid, doc_id, xxhash.xxh3_64_intdigest(content) >> 1, content, *best, n

        yield from batches(out(), LOCAL, size_of=lambda r: len(r[4] or b""))

    return run


def _global(table_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for text, *item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield text, item

        def start(item):
            rep, chars, doc, uid, n = item
            return [(chars, doc, uid), n, [rep]]

        def merge(value, item):
            rep, chars, doc, uid, n = item
            if better(mine := (chars, doc, uid), value[0]):
                value[0] = mine
            value[1] += n
            value[2].append(rep)

        def out():
            with tempfile.TemporaryDirectory() as folder:
                for _, content, ((_, doc, uid), n, reps) in grace(rows(), start, merge, table_bytes, folder):
                    sha = hashlib.sha256(content).hexdigest()
                    for rep in reps:
                        yield rep, doc, uid, n, sha

        yield from batches(out(), GROUPS)

    return run


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs (columns doc_id, text; others are ignored).

    Columns: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256, uid.
    Texts are equal if identical without characters of [\\x20\\x09-\\x0D]; a null or empty text is
    equal to any other text without further characters. Of equal texts the row with the most
    code points stays, then the smallest doc_id (null after all others), then the row read
    first; repeated rows thus leave exactly one. An empty table gives no rows.
    """
    local = written(id_and_text(docs).mapInArrow(_local(table_bytes), LOCAL_SQL))
    reps = local.where(F.col("part").isNotNull()).repartition("part").select("text", "rep_uid", "best_chars", "best_doc", "best_uid", "n")
    groups = reps.mapInArrow(_global(table_bytes), GROUPS_SQL)
    return local.select("uid", "rep_uid", "doc_id").join(groups, "rep_uid").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "uid")


def _best_rows(names: list[str], schema: pa.Schema, table_bytes: int, last: bool):
    doc_at, text_at = names.index("doc_id"), names.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for row in zip(*(c.to_pylist() for c in b.columns[: len(names)]), strict=True):
                    yield (row[text_at] or "").encode("utf-8", "surrogatepass").translate(None, SPACES), row

        def order(row):
            text, doc_id = row[text_at] or "", row[doc_at]
            return -len(text), doc_id is None, doc_id or 0, text

        def start(row):
            return [row]

        def merge(value, row):
            if order(row) < order(value[0]):
                value[0] = row

        def out():
            with tempfile.TemporaryDirectory() as folder:
                for _, content, (row,) in grace(rows(), start, merge, table_bytes, folder):
                    yield row if last else (*row, xxhash.xxh3_64_intdigest(content) >> 1)

        yield from batches(out(), schema, size_of=lambda r: 4 * len(r[text_at] or ""))

    return run


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns under their names; see exact_groups for which those are.

    Only the best row of each content leaves a partition, so groups of copies shrink before the
    one shuffle. Fully tied rows (same doc_id, as many characters) leave the one with the
    smallest text. An empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    part = "part"
    while part in docs.columns:
        part = "_" + part
    carried = StructType([*docs.schema.fields]).add(part, LongType())
    local = docs.mapInArrow(_best_rows(docs.columns, to_arrow_schema(carried), table_bytes, False), carried)
    return local.repartition(part).mapInArrow(_best_rows(docs.columns, to_arrow_schema(docs.schema), table_bytes, True), docs.schema)


#: DuckDB: the rows of op3_exact_dedup.
SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY k) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id)
"""
