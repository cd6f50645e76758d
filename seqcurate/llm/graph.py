"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcurate.llm.common import stage


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root) for every linked node; the root is the smallest node that it reaches.

    Each round first hangs a node's larger neighbours on its smallest one, then its smaller
    neighbours and itself; the smallest neighbour comes from an aggregation with partial sums and is
    joined back, so no node's neighbours ever meet in one task. Depth shrinks geometrically; each
    round's edges are written. Null ends and self-links are dropped; repeated links count once.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = stage(edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "graph")
    known = _checksum(edges)
    while known[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "graph")
        now = _checksum(edges)
        if now == known:
            break
        known = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
