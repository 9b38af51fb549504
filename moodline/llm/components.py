"""Connected components of a link table by alternating star contraction.

Every step is a partial aggregate (smallest neighbour of a node) and a join of
the links with it. A node linked to a third of all nodes is one row per task
in the aggregate, and the join's large partitions are split at run time. Each
round's links are written to the shared folder, so lineage stays short and a
lost executor costs one step; the round before is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodline.llm.common import drop_written, written


def _large_star(links: DataFrame) -> DataFrame:
    """Each neighbour greater than the node moves to the smallest of the neighbourhood."""
    both = links.unionByName(links.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
    least = both.groupBy("lo").agg(F.min("hi").alias("_m"))
    moved = both.filter("hi > lo").join(least, "lo")
    return moved.select("hi", F.least("_m", "lo").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each neighbour smaller than the node, and the node, move to the smallest."""
    least = links.groupBy("hi").agg(F.min("lo").alias("_m"))
    moved = links.join(least, "hi").filter("lo > _m").select(F.col("lo").alias("hi"), F.col("_m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("_m").alias("lo"))).distinct()


def _signature(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def component_roots(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b) that is not its own root;
    the root is the smallest node of its component. Self-links and repeated
    links are ignored; no link at all gives an empty table."""
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                  .distinct())
    seen = _signature(now)
    while True:
        large = written(_large_star(now))
        after = written(_small_star(large))
        new = _signature(after)
        drop_written(now)
        drop_written(large)
        now = after
        if new == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = new
