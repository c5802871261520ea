"""Sessions with the settings this library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution sizes shuffles and splits skewed joins at run time; the rest keeps results comparable.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.orc.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tessella", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS and, over them, settings with "__" for each dot in a name."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
