"""Small text files through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file at path, in any store that Spark can write."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
