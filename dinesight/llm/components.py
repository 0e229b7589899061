"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinesight.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``: the smallest node reachable.

    Every round links the larger neighbours of a node, then its smaller ones, to
    the smallest node around it. Minima combine before the shuffle and the
    join back can be split, so a node with very many edges stays spread. The
    number of rounds grows with the logarithm of the longest chain; each round
    is written out. No edges give no rows.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    if pairs.isEmpty():
        return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = stored(large.join(small, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
                       .select("e.*").where("hi <> lo").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first()
        if now == before:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(
                pairs.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
        before = now
