"""Session settings for this engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that suit any cluster: runtime re-planning, split of skewed joins, Arrow for Python stages.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Tiles are large rows; an Arrow batch of them must stay small.
TILE_BATCH_ROWS = 16


def session(name: str = "lumatile", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword names use _ for the dots of Spark's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
