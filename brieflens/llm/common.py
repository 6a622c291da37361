"""Shared helpers: the shared folder, reliable cuts of lineage, column name clashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only where that is unset (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="brieflens-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute once and keep the rows in the shared folder; later branches read them there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """As `cut`, but as a Parquet table, for wide rows of which a reader needs some columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


WIDE_ROWS = {  # Parquet looks at its sizes every 100 rows, which are hundreds of MB where a row has some; here at each row
    "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While a table is stored, Arrow maps get batches of about `size` instead of the session's, so a task holds few wide rows."""
    own = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, own)


def whole_text(column: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(taken: Iterable[str], wish: str) -> str:
    """`wish`, with underscores added until no column of that name (in any case) is there."""
    names = {x.lower() for x in taken}
    while wish.lower() in names:
        wish += "_"
    return wish


def bucketed(df: DataFrame, name: str, column: str) -> tuple[DataFrame, DataFrame]:
    """As `stored`, but bucketed and sorted by `column`: the table, which joins on it read without a shuffle, and its
    files as a plain table, whose shuffled joins adaptive execution can split."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, column).sortBy(column).option("path", path).saveAsTable(table)
    return spark.table(table), spark.read.schema(df.schema).parquet(path)
