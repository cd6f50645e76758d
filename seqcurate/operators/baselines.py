"""Baselines: majority label, binned cycle prior, scaled linear classifier, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import stage
from . import windows

K = len(S.PHASES)


def _attach(left: DataFrame, right: DataFrame, keys, column: str) -> DataFrame:
    """Add a column of a table with one row per key; without keys it is a scalar subquery.

    The table is written first, so its size is known: it is broadcast as any small file is, and the many rows
    of a key are not shuffled to one place.
    """
    if keys:
        return left.join(stage(right, "lookup"), list(keys), "left")
    return left.withColumn(column, right.select(column).scalar())


def majority(train: DataFrame, evaluation: DataFrame, keys=(), label: str = "target_label") -> DataFrame:
    """Most frequent training label, alphabetically first on a tie, for every evaluation row."""
    counts = train.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("y_pred"))
    return _attach(evaluation, best, keys, "y_pred")


def position_bin(bins: int):
    at = F.col("cycle_position").cast("string").try_cast("double")
    return F.when(at.isNotNull(), F.least(F.floor(at * bins), F.lit(bins - 1))).cast("bigint")


def binned_prior(train: DataFrame, evaluation: DataFrame, bins: int = 20, keys=(), label: str = "target_label") -> DataFrame:
    """Modal training label per cycle-position bin, the overall mode elsewhere.

    Ties go to the label that comes first in the cycle.
    """
    rows = train.withColumn("_bin", position_bin(bins)).filter("_bin is not null")
    counts = rows.groupBy(*keys, "_bin", label).agg(F.count(F.lit(1)).alias("_n"))
    mode = lambda n: F.min_by(label, F.struct(-n, S.phase_index(F.col(label))))
    lookup = counts.groupBy(*keys, "_bin").agg(mode(F.col("_n")).alias("_mode"))
    total = counts.groupBy(*keys, label).agg(F.sum("_n").alias("_n"))
    fallback = total.groupBy(*keys).agg(mode(F.col("_n")).alias("_fallback"))
    table = _attach(evaluation.withColumn("_bin", position_bin(bins)), lookup, [*keys, "_bin"], "_mode")
    out = _attach(table, fallback, keys, "_fallback").withColumn("y_pred", F.coalesce("_mode", "_fallback"))
    return out.drop("_bin", "_mode", "_fallback")


def class_weights(df: DataFrame, label: str = "target_label", root: bool = False, keys=()) -> DataFrame:
    """N / (K * count) per label of the vocabulary, count 1 for absent ones; optional square root."""
    index = S.phase_index(F.col(label), True)
    wide = df.withColumn("_i", index).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_i") == i).alias(f"_c{i}") for i in range(K)]
    )
    value = lambda i: F.col("_n") / (F.lit(float(K)) * F.greatest(F.col(f"_c{i}"), F.lit(1)))
    rows = [
        F.struct(
            F.lit(S.PHASES[i]).alias("label"),
            F.col(f"_c{i}").alias("frames"),
            (F.sqrt(value(i)) if root else value(i)).alias("weight"),
        )
        for i in range(K)
    ]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def boundary_weight(df: DataFrame, label: str = "target_label", order: str = "frame_index", keys=("sequence_id",)) -> DataFrame:
    """clip((N - positives) / positives, 1, 20); positives are label changes inside segments."""
    marked = windows.located_in_segment(df.select(*keys, order, label), list(keys), order, label)
    out = marked.agg(F.count(F.lit(1)).alias("frames"), F.sum("is_boundary").alias("_p"))
    positive = F.greatest(F.lit(1), F.coalesce("_p", F.lit(0)))
    raw = (F.col("frames") - positive) / positive
    return out.select("frames", positive.cast("bigint").alias("boundaries"), F.least(F.lit(20.0), F.greatest(F.lit(1.0), raw)).alias("boundary_weight"))


def linear_svm(train: DataFrame, evaluation: DataFrame, features: str, label: str, iterations: int = 20):
    """Standardised one-vs-rest linear SVM with balanced class weights (``features`` is an array).

    Returns evaluation rows with a ``prediction`` column holding the label's index.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    share = counts.agg((F.sum("_c") / F.count(F.lit(1))).alias("_share"))
    weights = counts.select(label, (share.scalar() / F.col("_c")).alias("_weight"))
    vector = array_to_vector(F.col(features))
    # The solver reads its input once per iteration, so it is staged first.
    rows = stage(train.join(stage(weights, "weights"), label).select(features, label, "_weight"), "svm").withColumn("_raw", vector)
    classifier = LinearSVC(maxIter=iterations, featuresCol="_scaled", weightCol="_weight", labelCol=label)
    model = Pipeline(
        stages=[
            StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled"),
            OneVsRest(classifier=classifier, featuresCol="_scaled", labelCol=label, weightCol="_weight", parallelism=8),
        ]
    ).fit(rows)
    return model.transform(evaluation.withColumn("_raw", vector)).drop("_raw", "_scaled")
