"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinesight.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges (a, b)``: the smallest node it is connected with.

    Star contraction: the larger neighbours of a node are linked to the smallest node around it, then every node keeps its
    smallest link. The rounds grow with the logarithm of the longest chain, each ends in a checkpoint, and minima combine
    before they are shuffled. Nodes are integers; no edges give no rows.
    """
    links = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    if links.isEmpty():
        return links.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    state = None
    while True:
        around = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        smallest = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(smallest, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        parent = large.groupBy("hi").agg(F.min("lo").alias("m"))
        both = F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        links = cut_lineage(large.join(parent, "hi").select(F.explode(both).alias("e")).select("e.*").where("hi <> lo").distinct())
        # Stars only: no node that others point to points on itself.
        found = links.agg(F.count("*").alias("n"), F.sum(F.col("hi").cast("decimal(38,0)")).alias("hi"), F.sum(F.col("lo").cast("decimal(38,0)")).alias("lo")).first()
        if found == state:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(
                links.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
        state = found
