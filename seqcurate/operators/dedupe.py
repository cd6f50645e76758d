"""Exact and near duplicate groups over content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import blocks, rules


def duplicate_hashes(df: DataFrame, key: str = "sha256", prefix: str = "exact-", width: int = 6) -> DataFrame:
    """Hashes seen more than once, numbered in hash order.

    Counting combines before the shuffle, so one content with very many copies is one row per
    task there. Numbering runs over the repeated hashes only, in buckets of the hash prefix.
    """
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    ranked = blocks.rank(repeated, [], [key], F.substring(key, 1, 3), "_number")
    number = (F.col("_number") + 1).cast("string")
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return ranked.select(key, "copies", F.concat(F.lit(prefix), padded).alias("duplicate_group"))


def assign_groups(df: DataFrame, key: str = "sha256") -> DataFrame:
    """Add ``duplicate_group``; null for content seen once.

    The join is on the content hash: hot contents are split by the adaptive skew join.
    """
    groups = duplicate_hashes(df, key).select(key, "duplicate_group")
    return df.drop("duplicate_group").join(groups, key, "left")


def audit_exact(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("duplicate_group").isNotNull())
        .groupBy("duplicate_group")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.count_distinct("subject_id").alias("subjects"),
            F.count_distinct("dataset").alias("datasets"),
        )
    )


def audit_near(df: DataFrame, key: str = "perceptual_hash") -> DataFrame:
    """Groups of a near-duplicate key with more than one sample (sort at the sink); no key is no group."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.count_distinct("subject_id").alias("subjects"),
            F.count_distinct("dataset").alias("datasets"),
            F.count_distinct("sequence_id").alias("sequences"),
        )
        .filter("samples > 1")
    )


def audit_summary(exact: DataFrame, near: DataFrame) -> DataFrame:
    """Counts of groups and members; zero when there are none."""
    whole = lambda col: F.coalesce(F.sum(col), F.lit(0)).cast("bigint")
    left = exact.agg(
        F.count(F.lit(1)).alias("exact_groups"),
        whole("samples").alias("exact_members"),
        F.count_if(F.col("subjects") > 1).alias("exact_cross_subject_groups"),
    )
    right = near.agg(
        F.count(F.lit(1)).alias("perceptual_collision_groups"),
        whole("samples").alias("perceptual_collision_members"),
        F.count_if(F.col("subjects") > 1).alias("perceptual_cross_subject_groups"),
        F.count_if(F.col("datasets") > 1).alias("perceptual_cross_dataset_groups"),
    )
    return blocks.one_row(left, right)


def mark_cross_subject(df: DataFrame, key: str = "duplicate_group", reason: str = S.CROSS_SUBJECT_REASON):
    """Exclude content shared by several subjects; an existing reason stays.

    Rows without a group get a key of their own, so they spread over all join tasks.
    """
    if "exclusion_reason" not in df.columns:
        df = df.withColumn("exclusion_reason", F.lit(None).cast("string"))
    shared = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*rules.hash_ends(F.col("subject_id"), "s"))
        .filter(rules.several("s"))
        .select(F.col(key).alias("_key"), F.lit(True).alias("_shared"))
    )
    new = F.when(F.col("_shared"), F.coalesce("exclusion_reason", F.lit(reason))).otherwise(F.col("exclusion_reason"))
    keyed = df.withColumn("_key", F.coalesce(key, F.concat(F.lit("~"), "sample_id")))
    return keyed.join(shared, "_key", "left").withColumn("exclusion_reason", new).drop("_shared", "_key")

