"""Connected components by alternating large-star and small-star rounds over stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apilens.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; ``component`` is the least node that it reaches.

    Integer nodes. Edges without one of their ends and loops are left out; no edges give an empty table. Each
    round replaces neighbours by the least neighbour, which flattens a path of n nodes in O(log n)
    rounds, and is written to the shared folder: neither edges nor components reach the driver. A round shuffles the
    edges twice, gives one edge for each, and tells whether it moved any.
    """
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v"), "links")
    while True:
        links = stored(_small_star(_large_star(links)), "links")
        if not links.agg(F.max("moved")).first()[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its least neighbour (itself included) to its larger neighbours. Repeated edges leave first."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least("u", F.min("v").over(W.partitionBy("u")))
    known = both.repartition("u").distinct().withColumn("least", least).filter("v > u")
    return known.select(F.col("v").alias("u"), F.col("least").alias("v"), (F.col("least") < F.col("u")).alias("moved"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its least neighbour to its other smaller neighbours and takes it itself."""
    known = links.withColumn("least", F.min("v").over(W.partitionBy("u")))
    other = F.col("v") > F.col("least")
    return known.select(
        F.when(other, F.col("v")).otherwise(F.col("u")).alias("u"), F.col("least").alias("v"), (F.col("moved") | other).alias("moved")
    )
