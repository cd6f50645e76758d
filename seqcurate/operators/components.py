"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of every linked node; the root is the smallest node that it reaches.

    Rounds of star contraction: first every node hands its smallest neighbour to its larger ones, then
    the smallest to the rest of its smaller ones; paths shrink geometrically. The smallest neighbour
    is an aggregate that combines before its shuffle and comes back by an equi join, which the adaptive skew
    join cuts for a node with very many links; no node's links are listed. A round's table is
    written, so lineage stays short. Links to nothing or to oneself and repeated links do not matter.
    """
    ends = (F.greatest(left, right).alias("high"), F.least(left, right).alias("low"))
    known = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    edges, before = stage(known.select(*ends).distinct(), "edges"), None
    while (now := _sum_of(edges)) != before:
        before = now
        edges = stage(_towards_smallest(_larger_to_smallest(edges)), "edges")
    inner = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return inner.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def _sum_of(edges: DataFrame) -> tuple:
    """Equal for equal tables; a table whose stars are final maps to itself."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def _larger_to_smallest(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("low").alias("node"), F.col("high").alias("other"))
    every = turned.unionByName(edges.select(F.col("high").alias("node"), F.col("low").alias("other")))
    smallest = every.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
    return turned.join(smallest, "node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def _towards_smallest(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("high").agg(F.min("low").alias("least"))
    rest = edges.join(smallest, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return rest.unionByName(smallest.withColumnRenamed("least", "low")).distinct()
