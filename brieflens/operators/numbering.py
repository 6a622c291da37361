"""Top-k, row numbers and running totals that never put one group in one task.

A window without a bounded partition pulls a whole group through one task.
The helpers here keep every window bounded:

* `top_k` relies on the window group limit: each task first keeps its own k
  rows per group, so at most k rows per group and task are shuffled.
* `number_by_id` cuts a group into id ranges, `running_total` a whole table
  into key ranges; both number or sum inside each range and add the offset of
  the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | Column, rank: str = "rn") -> DataFrame:
    """The first `k` rows of each group, numbered from 1 in column `rank`."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def number_by_id(df: DataFrame, by: list[str], id_col: str, out: str, width: int = 100_000) -> DataFrame:
    """1-based position of each row within its group, ordered by a unique integer id.

    Ids are cut into ranges of `width`, so a range holds at most `width` rows
    however large the group is; only one row per range enters the offset window.
    """
    part = F.floor(F.col(id_col) / width)
    ranged = df.withColumn("_range", part)
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(id_col))
    numbered = ranged.withColumn("_inside", inside)
    return (
        numbered.join(offsets, [*by, "_range"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_range", "_inside", "_offset")
    )


def running_total(df: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """Sum of `amount` over all rows whose `order` is smaller; meant for a table of distinct keys with their counts.

    Keys are dealt out by ranges and kept in the shared folder with the number of
    their range, as range bounds are drawn anew each time they are asked for.  A
    window then sums inside a range, and each range adds the totals of those before
    it (one row per range, met pair by pair), so no task sees more than a range.
    """
    ranged = stored(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_total"))
    earlier = totals.select(F.col("_range").alias("_before"), F.col("_total").alias("_more"))
    offsets = totals.join(earlier, F.col("_before") < F.col("_range"), "left").groupBy("_range").agg(
        F.coalesce(F.sum("_more"), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_inside", F.sum(amount).over(inside))
    same = Window.partitionBy("_range", order)
    placed = summed.withColumn("_own", F.sum(amount).over(same)).join(offsets, "_range")
    return placed.withColumn(out, F.col("_offset") + F.col("_inside") - F.col("_own")).drop("_range", "_offset", "_inside", "_own")
