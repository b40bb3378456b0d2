"""Structured Streaming over fields of view: each file that lands is decoded, counts are kept by gene and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.decode import decode_metric, decode_per_round_max


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of features that land in folder, some per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def decode_stream(features: DataFrame, codes: DataFrame, rounds: int, channels: int, max_distance: float | None = None, min_intensity: float = 0.0) -> DataFrame:
    """Decoded features; no state: the codebook is static. By the largest channel per round, or by distance if max_distance is given."""
    if max_distance is None:
        return decode_per_round_max(features, codes, rounds, channels)
    return decode_metric(features, codes, rounds * channels, max_distance, min_intensity)


def gene_counts(decoded: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per target and window of event time; what comes later than `late` is dropped, and closed windows leave the state."""
    return decoded.where("target IS NOT NULL").withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "target").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "target", "n")


def run_to_table(stream: DataFrame, table_path: str, checkpoint: str, mode: str = "append"):
    """Write what is there now to Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
