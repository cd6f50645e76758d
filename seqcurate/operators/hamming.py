"""64-bit hashes within a Hamming distance of one another.

Equal hashes are one item from the start. If two hashes differ in k bits at most, then of k + 1 bands one
is equal (pigeonhole), so items meet on an equal band and every close pair meets: recall is
1. In a bucket of at most ``BUCKET`` items pairs are verified by the number of differing bits.

A larger bucket is not compared at all. Its items send themselves to every number that differs from them in at
most ceil(k/2) of the bits that the bucket leaves open. Two items are within k exactly when they meet at a number that one
reaches with floor(k/2) steps and the other with ceil(k/2); so all that meet at a number are linked with one
such near item there. That is a fixed number of rows an item (for k = 2 at most 65, for k = 3 about 1,200), however
alike the hashes are, and components come out the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import components

BITS = 64
#: Most items of a bucket whose pairs are compared.
BUCKET = 256


def number(hash_hex: Column) -> Column:
    """16 hex digits as a long (two's complement); anything else is null."""
    half = lambda at: F.conv(F.substring(hash_hex, at, 8), 16, 10).cast("bigint")
    return F.when(hash_hex.rlike("^[0-9a-f]{16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bands(parts: int) -> list[int]:
    """Masks of ``parts`` neighbouring bands that cover all bits."""
    edges = [BITS * p // parts for p in range(parts + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]


def _reached(items: DataFrame, steps: int) -> DataFrame:
    """(h, x, d): every x that differs from ``h`` in d <= ``steps`` bits outside ``mask``, once per item and mask."""
    last = items.select("h", "mask", F.col("h").alias("x"), F.lit(-1).alias("at"), F.lit(0).alias("d"))
    every = last
    for step in range(steps):
        places = F.when(F.col("at") < BITS - 1, F.sequence(F.col("at") + 1, F.lit(BITS - 1)))
        free = F.expr("filter(_places, i -> (mask & shiftleft(1L, i)) = 0)")
        last = last.withColumn("_places", places).select("h", "mask", "x", F.explode(free).alias("at"))
        last = last.select("h", "mask", F.expr("x ^ shiftleft(1L, at)").alias("x"), "at", F.lit(step + 1).alias("d"))
        every = every.unionByName(last)
    return every.select("h", "x", "d")


def _met(crowded: DataFrame, distance: int) -> DataFrame:
    """Links between the items of crowded buckets, without comparing them."""
    reached = stage(_reached(crowded, (distance + 1) // 2), "reached")
    near = F.when(F.col("d") <= distance // 2, F.col("h"))
    centres = reached.groupBy("x").agg(F.min(near).alias("first"), F.min("h").alias("low"), F.max("h").alias("high"))
    centres = centres.where("first is not null and low < high").select("x", "first")
    met = reached.join(centres, "x").where("h <> first")
    return met.select(F.least("h", "first").alias("a"), F.greatest("h", "first").alias("b"))


def links(items: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b, of the distinct longs ``h`` that differ in at most ``distance`` bits.

    Every such pair, except within crowded buckets, where linked items are all connected through one another.
    """
    if not 0 <= distance < BITS:
        raise ValueError("The distance must be between 0 and 63 bits.")
    masks = F.explode(F.array(*[F.lit(_signed(m)) for m in bands(distance + 1)])).alias("mask")
    placed = items.select("h", masks).withColumn("key", F.expr("h & mask"))
    sizes = placed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = stage(placed.join(sizes, ["mask", "key"]), "buckets")
    few = held.where(F.col("n") <= bucket).select("mask", "key", "h")
    close = F.expr(f"h < b and bit_count(h ^ b) <= {int(distance)}")
    pairs = few.join(few.withColumnRenamed("h", "b"), ["mask", "key"]).where(close).select(F.col("h").alias("a"), "b")
    return pairs.unionByName(_met(held.where(F.col("n") > bucket), distance)).distinct()


def near_groups(df: DataFrame, key: str = "perceptual_hash", distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per distinct hash: ``key``, samples, near_group (smallest hash reachable in steps of at most ``distance`` bits).

    Hashes that are null or not 16 hex digits belong to no group and have no row.
    """
    counted = df.select(key, number(F.col(key)).alias("h")).where("h is not null").groupBy(key, "h").agg(F.count(F.lit(1)).alias("samples"))
    counted = stage(counted, "hashes")
    text = lambda h: F.lpad(F.lower(F.hex(F.col(h))), 16, "0")
    joined = links(counted, distance, bucket).select(text("a").alias("a"), text("b").alias("b"))
    roots = components(joined, "a", "b").withColumnRenamed("node", key)
    return counted.join(roots, key, "left").select(key, "samples", F.coalesce("root", key).alias("near_group"))
