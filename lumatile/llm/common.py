"""Helpers shared by the text operators: scratch tables, row streams, byte classes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every operator here: \x20 and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z only and leaves every other byte of UTF-8 alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of an Arrow batch given back to Spark hold at most about so many bytes.
BATCH_BYTES = 8 << 20

_stored: list[tuple[SparkSession, str]] = []
_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one if all runs on one machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="lumatile-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df, computed once into a Parquet table in the shared folder; this cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lumatile-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Like written(), but release() leaves the table; the process deletes it at its end."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lumatile-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete all tables of written(). Call it once the results that read them are stored."""
    while _written:
        spark, path = _written.pop()
        _delete(spark, path)


def drop_written(since: int, keep: int = 0) -> None:
    """Delete the tables written after the first `since`, except for the last `keep`."""
    end = max(since, len(_written) - keep)
    for spark, path in _written[since:end]:
        _delete(spark, path)
    del _written[since:end]


def written_count() -> int:
    return len(_written)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
        while _stored:
            _delete(*_stored.pop())
    except Exception:  # the JVM may be gone by now; the folder's owner clears it then
        _written.clear()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes (null: empty) and further columns; all other columns of the input are left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        *(F.col(c) for c in more),
    )


def batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 20_000, size_of=None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, by number and, with size_of(row), by bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row) if size_of else 0
        if len(held) >= limit or size >= BATCH_BYTES:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
