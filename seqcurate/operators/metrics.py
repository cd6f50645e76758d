"""Scores per label, subject, condition, transition and boundary.

Everything starts from one aggregate: per (keys, subject) the true, predicted and correct
count of each label. Larger groupings sum those counts, so the rows are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import asof, blocks, windows

K = len(S.PHASES)


def _indexed(df: DataFrame) -> DataFrame:
    return df.withColumn("_t", S.phase_index(F.col("y_true"), True)).withColumn("_p", S.phase_index(F.col("y_pred"), True))


def _tallies(true: Column, found: Column, rows: Column, prefix: str = "") -> list[Column]:
    """Rows by label index, true, predicted and both, among ``rows``."""
    out = []
    for i in range(K):
        out.append(F.count_if(rows & (true == i)).alias(f"{prefix}_t{i}"))
        out.append(F.count_if(rows & (found == i)).alias(f"{prefix}_p{i}"))
        out.append(F.count_if(rows & (true == i) & (found == i)).alias(f"{prefix}_h{i}"))
    return out


def label_counts(true: str, found: str, rows: Column, prefix: str = "") -> list[Column]:
    """Aggregates of two label columns, of the rows where ``rows`` holds; the counts that all scores come from."""
    # An unknown label stops the job; a row outside ``rows`` has none to check.
    index = lambda c: F.when(rows, S.phase_index(F.col(c), True))
    return _tallies(index(true), index(found), rows, prefix)


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("_n"), *_tallies(F.col("_t"), F.col("_p"), F.lit(True))]


_COUNT_NAMES = ["_n"] + [f"_{kind}{i}" for i in range(K) for kind in "tph"]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _f1(i: int, prefix: str = "") -> Column:
    return _ratio(2 * F.col(f"{prefix}_h{i}"), F.col(f"{prefix}_t{i}") + F.col(f"{prefix}_p{i}"))


def macro_f1(prefix: str = "") -> Column:
    """Mean F1 over all labels of summed label counts; an absent label counts as zero."""
    return sum((_f1(i, prefix) for i in range(1, K)), _f1(0, prefix)) / F.lit(float(K))


def balanced_accuracy() -> Column:
    """Mean recall over the labels that occur, of summed label counts."""
    total, present = F.lit(0.0), F.lit(0)
    for i in range(K):
        total = total + _ratio(F.col(f"_h{i}"), F.col(f"_t{i}"))
        present = present + F.when(F.col(f"_t{i}") > 0, 1).otherwise(0)
    return F.try_divide(total, present)


def frame_metrics() -> dict[str, Column]:
    """Metrics of summed subject counts, by name."""
    return {"frame_macro_f1": macro_f1(), "balanced_accuracy": balanced_accuracy()}


def subject_counts(df: DataFrame, keys=()) -> DataFrame:
    return _indexed(df).groupBy(*keys, "subject_id").agg(*_counts())


def subject_scores(df: DataFrame, keys=()) -> DataFrame:
    """Macro-F1 per subject over all labels; an absent label counts as zero."""
    out = subject_counts(df, keys).withColumn("macro_f1", macro_f1())
    return out.select(*keys, "subject_id", F.col("_n").alias("samples"), "macro_f1")


def overall(df: DataFrame, keys=()) -> DataFrame:
    """Samples, subjects, subject and frame macro-F1 and balanced accuracy per key."""
    per_subject = subject_counts(df, keys).withColumn("_score", macro_f1())
    sums = [F.sum(c).alias(c) for c in _COUNT_NAMES]
    out = per_subject.groupBy(*keys).agg(
        *sums, F.count(F.lit(1)).alias("subjects"), F.avg("_score").alias("subject_macro_f1")
    )
    return out.select(
        *keys,
        F.col("_n").alias("samples"),
        "subjects",
        "subject_macro_f1",
        macro_f1().alias("frame_macro_f1"),
        balanced_accuracy().alias("balanced_accuracy"),
    )


def confusion(df: DataFrame, keys=()) -> DataFrame:
    """Long confusion matrix with its zero cells, in one grouping pass."""
    cells = [
        F.count_if((F.col("_t") == i) & (F.col("_p") == j)).alias(f"_c{i}{j}") for i in range(K) for j in range(K)
    ]
    wide = _indexed(df).groupBy(*keys).agg(*cells)
    rows = [
        F.struct(F.lit(S.PHASES[i]).alias("y_true"), F.lit(S.PHASES[j]).alias("y_pred"), F.col(f"_c{i}{j}").alias("n"))
        for i in range(K)
        for j in range(K)
    ]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_c")).select(*keys, "_c.*")


def per_class(df: DataFrame, keys=()) -> DataFrame:
    wide = _indexed(df).groupBy(*keys).agg(*_counts())
    rows = [
        F.struct(
            F.lit(S.PHASES[i]).alias("phase"),
            _ratio(F.col(f"_h{i}"), F.col(f"_p{i}")).alias("precision"),
            _ratio(F.col(f"_h{i}"), F.col(f"_t{i}")).alias("recall"),
            _f1(i).alias("f1"),
            F.col(f"_t{i}").alias("support"),
        )
        for i in range(K)
    ]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_c")).select(*keys, "_c.*")


def transition_validity(df: DataFrame, keys=(), order: str = "frame_index") -> DataFrame:
    """Share of consecutive predictions (gaps ignored) that follow the label cycle.

    Pairs inside a block are counted there; the pair across a border comes from the first and
    last prediction of neighbouring blocks. Rows are shuffled once.
    """
    unit = [*keys, "subject_id", "sequence_id"]
    rows = df.select(*unit, order, S.phase_index(F.col("y_pred"), True).alias("_p"))
    rows = blocks.spread(rows.withColumn(blocks.BLOCK, blocks.block_of(F.col(order))), unit)
    previous = F.lag("_p").over(blocks.per_block(unit).orderBy(order))
    allowed = S.transition_allowed(previous, F.col("_p")).cast("bigint")
    rows = rows.withColumn("_ok", F.when(previous.isNotNull(), allowed))
    table = rows.groupBy(*unit, blocks.BLOCK).agg(
        F.count("_ok").alias("_pairs"),
        F.coalesce(F.sum("_ok"), F.lit(0)).alias("_valid"),
        F.min_by("_p", order).alias("_first"),
        F.max_by("_p", order).alias("_last"),
    )
    before = F.lag("_last").over(Window.partitionBy(*unit).orderBy(blocks.BLOCK))
    table = table.withColumn("_before", before)
    border = F.when(F.col("_before").isNotNull(), S.transition_allowed(F.col("_before"), F.col("_first")).cast("bigint"))
    table = table.withColumn("_border", border)
    return table.groupBy(*keys).agg(
        (F.sum("_pairs") + F.count("_border")).alias("pairs"),
        F.try_divide(
            F.sum("_valid") + F.coalesce(F.sum("_border"), F.lit(0)), F.sum("_pairs") + F.count("_border")
        ).alias("transition_validity"),
    )


def boundary_classification(df: DataFrame, threshold: float = 0.5, keys=()) -> DataFrame:
    hit, true = F.col("boundary_probability") >= threshold, F.col("y_boundary") == 1
    wide = df.groupBy(*keys).agg(
        F.count_if(hit & true).alias("_h"),
        F.count_if(hit).alias("predicted_boundary_frames"),
        F.count_if(true).alias("true_boundaries"),
    )
    return wide.select(
        *keys,
        F.lit(float(threshold)).alias("threshold"),
        _ratio(F.col("_h"), F.col("predicted_boundary_frames")).alias("precision"),
        _ratio(F.col("_h"), F.col("true_boundaries")).alias("recall"),
        _ratio(2 * F.col("_h"), F.col("predicted_boundary_frames") + F.col("true_boundaries")).alias("f1"),
        "true_boundaries",
        "predicted_boundary_frames",
    )


def predicted_boundaries(df: DataFrame, threshold: float = 0.5, keys=(), order: str = "frame_index") -> DataFrame:
    """Runs of frames over the threshold, each reduced to its most probable frame."""
    unit = [*keys, "sequence_id"]
    hits = df.filter(F.col("boundary_probability") >= threshold).select(*unit, order, "boundary_probability")
    return windows.run_peaks(hits, unit, order, "boundary_probability")


def boundary_errors(df: DataFrame, threshold: float = 0.5, keys=(), order: str = "frame_index") -> DataFrame:
    """Distance of every true boundary to the nearest predicted one of its sequence."""
    unit = [*keys, "sequence_id"]
    truth = df.filter("y_boundary = 1").select(*unit, order)
    found = predicted_boundaries(df, threshold, keys, order).select(*unit, order)
    return asof.nearest(truth, found, unit, order, "error_frames")


def boundary_timing(df: DataFrame, threshold: float = 0.5, keys=(), order: str = "frame_index") -> DataFrame:
    """Timing error summary; sequences without a prediction contribute nothing."""
    errors = boundary_errors(df, threshold, keys, order)
    e = F.col("error_frames")
    return errors.groupBy(*keys).agg(
        F.count("error_frames").alias("matched_true_boundaries"),
        F.avg(e).alias("mean_absolute_error_frames"),
        F.percentile(e, F.lit(0.5)).alias("median_absolute_error_frames"),
        F.avg((e <= 1).cast("double")).alias("within_one_frame"),
        F.avg((e <= 2).cast("double")).alias("within_two_frames"),
    )
