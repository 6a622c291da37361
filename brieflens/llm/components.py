"""Connected components of a link table, by least labels with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long); the root is the smallest node of its component.

    Each round a node takes the least label of its neighbours, the node it was
    labelled with takes it too, and labels are followed one step.  Rounds are cut
    by checkpoints; their number grows with the logarithm of a component's width.
    Every grouping has a map-side part and every join has unique keys on one side,
    so a node with very many links is dealt out over tasks.
    """
    both = cut(links.select("a", "b").filter("a != b").union(links.select("b", "a").filter("a != b")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    total = None
    while True:
        least = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        seen = labels.join(least, F.col("node") == F.col("a")).select("node", "root", "near")
        offers = (seen.select("node", F.least("root", "near").alias("root"))
                  .union(seen.select(F.col("root").alias("node"), F.least("root", "near").alias("root"))))
        hooked = cut(offers.groupBy("node").agg(F.min("root").alias("root")))
        jump = hooked.select(F.col("node").alias("via"), F.col("root").alias("next"))
        labels = cut(hooked.join(jump, F.col("root") == F.col("via")).select("node", F.least("root", "next").alias("root")))
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == total or now is None:
            return labels
        total = now
