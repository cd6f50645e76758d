"""What the text operators share: reading, staging, label folds and size-checked lookups."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcurate.session import stage

#: A lookup side of at most this many rows is broadcast; a larger one is joined by a shuffle.
LOOKUP_ROWS = 2_000_000
_HELD: dict[str, Callable[[], object]] = {}


def take_over(owner: str, release: Callable[[], object] | None = None) -> None:
    """A Python worker serves one operator after another: lets go what others keep in this process, and notes how to let go what ``owner`` keeps."""
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        gc.collect()
    if release is not None:
        _HELD[owner] = release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *columns: str) -> str:
    """``name``, or a longer one if a table already has it."""
    while name in columns:
        name = f"_{name}"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """One (id, label) row per labelled id; of several labels the largest holds, null labels and ids are none."""
    rows = labels.select(F.col(id_col), F.col(label).cast("int").alias("label"))
    return rows.where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1)).groupBy(id_col).agg(F.max("label").alias("label"))


def join_lookup(rows: DataFrame, lookup: DataFrame, key, how: str = "inner", limit: int = LOOKUP_ROWS) -> DataFrame:
    """Join with a lookup table, written first, and broadcast when it has at most ``limit`` rows; the result is the same."""
    lookup = stage(lookup, "lookup")
    small = lookup.count() <= limit
    return rows.join(F.broadcast(lookup) if small else lookup, key, how)


def number_rows(rows: DataFrame, key: str, order: list[Column], buckets: int = 1024) -> DataFrame:
    """Adds ``_row``: 0, 1, ... within ``key`` in the order of (bucket, order).

    Rows are cut by a hash of their order columns, so a key with a third of all rows is numbered
    by ``buckets`` tasks: counts per (key, bucket) give each bucket its first number. A null key is a key.
    """
    from pyspark.sql import Window

    cut = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = cut.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    inner = Window.partitionBy(key, "_bucket").orderBy(*order)
    local = cut.withColumn("_local", F.row_number().over(inner) - 1)
    joined = join_lookup(local, first, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_row", F.col("_first") + F.col("_local")).drop("_key", "_b", "_first", "_local", "_bucket")


__all__ = ["LOOKUP_ROWS", "fold", "join_lookup", "labelled", "number_rows", "stage", "table", "take_over", "unused"]
