"""Totals of a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_summary(df: DataFrame) -> DataFrame:
    """One row of totals.

    The first grouping (per subject, sequence and duplicate group) combines before the shuffle,
    so the distinct counts run over few rows.
    """
    first = df.groupBy("subject_id", "sequence_id", "duplicate_group").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("adjudicated_label").alias("_labelled"),
        F.count("exclusion_reason").alias("_excluded"),
    )
    return first.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("samples"),
        F.count_distinct("subject_id").alias("subjects"),
        F.count_distinct("sequence_id").alias("sequences"),
        F.count_distinct("duplicate_group").alias("exact_duplicate_groups"),
        F.coalesce(F.sum("_labelled"), F.lit(0)).alias("adjudicated_samples"),
        F.coalesce(F.sum("_excluded"), F.lit(0)).alias("excluded_samples"),
    )


def condition_counts(df: DataFrame) -> DataFrame:
    """Samples in all, per dataset and per (dataset, condition), in one pass."""
    counts = df.groupingSets([[], ["dataset"], ["dataset", "condition"]], "dataset", "condition").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("samples")
    )
    level = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "dataset").otherwise("condition")
    return counts.select(level.alias("level"), "dataset", "condition", "samples")
