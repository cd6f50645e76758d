"""As-of and nearest matching as a union and a fill, without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks


def backward(left: DataFrame, right: DataFrame, keys, on: str, start: str = "start", end: str = "end") -> DataFrame:
    """For each left row the greatest right point <= it (``start``) and the next one (``end``)."""
    rows = left.withColumn("_kind", F.lit(1)).withColumn("_point", F.lit(None).cast("bigint"))
    points = right.select(*keys, on, F.lit(0).alias("_kind"), F.col(on).alias("_point"))
    both = rows.unionByName(points, allowMissingColumns=True)
    point = F.col("_point")
    out = blocks.carry(both, list(keys), on, last={start: point}, first={end: point}, tie=("_kind",), rising=True)
    return out.filter("_kind = 1").drop("_kind", "_point")


def nearest(left: DataFrame, right: DataFrame, keys, on: str, name: str = "distance") -> DataFrame:
    """Distance from each left row to the closest right row of the same key; null if there is none."""
    out = backward(left, right, keys, on, "_below", "_above")
    down, up = F.col(on) - F.col("_below"), F.col("_above") - F.col(on)
    return out.withColumn(name, F.least(down, up)).drop("_below", "_above")
