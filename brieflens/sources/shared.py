"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


WIDE_ROWS = {  # Parquet looks at its sizes every 100 rows, which are hundreds of MB where a row is a block; here at each row
    "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it; the warehouse where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Compute once and keep as a table in the shared folder, for what several branches read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
