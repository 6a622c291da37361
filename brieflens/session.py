"""Session defaults shared by tests, the bench and ad-hoc use."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that are right at any size.  Partition counts are left to adaptive
# execution: it starts from `initialPartitionNum` and coalesces, so the same
# job suits 60 MB and 100 TB.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("brieflens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.brieflens.inputPartitions", str(shuffle_partitions))
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
