"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrogrid.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (src, dst) rows: the smallest node each can reach.

    Alternates linking every larger neighbour, then every smaller one, to the
    smallest known node; each round is two grouped minima with joins back, so no
    neighbour list is ever collected.  Nodes without links are not listed.
    """
    both = edges.filter("src <> dst")
    current = cut_lineage(both.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    previous = None
    while True:
        mirrored = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = mirrored.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = (
            mirrored.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        ).filter("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        joined = large.join(low, "src")
        small = (
            joined.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .unionByName(joined.select("src", F.col("low").alias("dst")))
            .filter("src <> dst")
            .distinct()
        )
        current = cut_lineage(small)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if state == previous:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        previous = state
