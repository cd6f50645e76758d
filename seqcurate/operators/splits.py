"""Deterministic, leakage-free subject splits and fold views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import ids
from . import blocks


def hash_order(value: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), value), 256)


def subject_table(subjects: DataFrame, test_fraction: float = 0.20, folds: int = 5, seed: int = S.SEED) -> DataFrame:
    """(dataset, subject_id) -> split, fold. Work is per subject, not per row.

    Subjects are numbered along their seeded hash; hash prefixes are the rank buckets, so a
    dataset with very many subjects is numbered in parallel. Too few subjects stop the job.
    """
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must be between zero and one.")
    if folds < 2:
        raise ValueError("At least two development folds are required.")
    keyed = subjects.select("dataset", "subject_id").distinct()
    keyed = keyed.withColumn("_h", hash_order(F.col("subject_id"), seed))
    ranked = blocks.rank(keyed, ["dataset"], ["_h", "subject_id"], F.substring("_h", 1, 3), "_pos", "_n")
    short = F.concat(F.lit("Too few subjects in dataset "), F.col("dataset"))
    size = F.when(F.col("_n") < folds + 1, F.raise_error(short).cast("bigint")).otherwise(F.col("_n"))
    held = F.greatest(F.lit(1), F.ceil(size * F.lit(float(test_fraction))))
    test = F.col("_pos") < held
    return ranked.select(
        "dataset",
        "subject_id",
        F.when(test, "test").otherwise("development").alias("split"),
        F.when(test, -1).otherwise(F.pmod(F.col("_pos") - held, F.lit(folds))).cast("int").alias("fold"),
    )


def make_subject_splits(df: DataFrame, test_fraction=0.20, folds=5, seed: int = S.SEED) -> DataFrame:
    """Mark cross-subject duplicates and give every row its split and fold."""
    from .dedupe import mark_cross_subject

    marked = mark_cross_subject(df.drop("split", "fold"))
    table = subject_table(df, test_fraction, folds, seed)
    # A row without subject or dataset stays, without a split, for the rules to report.
    named = table.withColumnsRenamed({"dataset": "_dataset", "subject_id": "_subject"})
    same = F.col("dataset").eqNullSafe(F.col("_dataset")) & F.col("subject_id").eqNullSafe(F.col("_subject"))
    return marked.join(named, same, "left").drop("_dataset", "_subject")


def subjects_per_split(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset", "split").agg(F.count_distinct("subject_id").alias("subjects"))


def eligible_labeled(df: DataFrame, source: str = "adjudicated", allow_provisional: bool = False) -> DataFrame:
    """Rows with a usable label from the chosen source, plus target_* columns.

    Provisional labels need an explicit flag and must all be of medium confidence.
    """
    if source == "adjudicated":
        label, origin, version = F.col("adjudicated_label"), F.lit("human_adjudicated"), F.lit("")
        confidence = F.col("annotation_confidence") if "annotation_confidence" in df.columns else F.lit("")
    elif source == "provisional":
        if not allow_provisional:
            raise S.RuleViolation("Provisional labels need allow_provisional=True.")
        S.require_columns(df, S.PREPARED_EXTRA[:4], "prepared manifest")
        label, origin = F.col("provisional_label"), F.col("provisional_source")
        version = F.col("provisional_version")
        # Checked over all rows before any filter; a check inside a column would go with the column.
        if not df.filter(~F.col("provisional_confidence").eqNullSafe("medium")).isEmpty():
            raise S.RuleViolation("Provisional labels must be of medium confidence.")
        confidence = F.col("provisional_confidence")
    else:
        raise S.RuleViolation(f"Unknown label source: {source}")
    kept = df.filter(label.isin(*S.PHASES) & F.col("exclusion_reason").isNull())
    return kept.withColumns(
        {
            "target_label": label,
            "target_label_source": origin,
            "target_annotation_version": version,
            "target_annotation_confidence": confidence,
        }
    )


def prediction_table(rows: DataFrame, predicted: str = "y_pred") -> DataFrame:
    """Identity columns, truth, prediction and label provenance of scored rows."""
    return rows.select(
        "sample_id",
        "dataset",
        "subject_id",
        "sequence_id",
        "condition",
        "frame_index",
        F.col("target_label").alias("y_true"),
        F.col(predicted).alias("y_pred"),
        F.col("target_label_source").alias("label_source"),
        F.col("target_annotation_version").alias("annotation_version"),
        F.col("target_annotation_confidence").alias("annotation_confidence"),
    )


def select_partition(
    df: DataFrame,
    mode: str = "validation",
    fold: int = 0,
    training_dataset: str = "pooled",
    evaluation_dataset: str = "match",
    allow_test: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(train, evaluation) rows; the test split needs an explicit acknowledgement."""
    development = df.filter(F.col("split") == "development")
    if mode == "test":
        if not allow_test:
            raise S.RuleViolation("Test evaluation needs allow_test=True.")
        train, evaluation = development, df.filter(F.col("split") == "test")
    else:
        train, evaluation = development.filter(F.col("fold") != fold), development.filter(F.col("fold") == fold)
    if training_dataset != "pooled":
        train = train.filter(F.col("dataset") == training_dataset)
    target = training_dataset if evaluation_dataset == "match" else evaluation_dataset
    if target != "pooled":
        evaluation = evaluation.filter(F.col("dataset") == target)
    return train, evaluation


def split_by_confidence(joined: DataFrame, confidence: str = "medium") -> tuple[DataFrame, DataFrame]:
    """Primary rows with provisional_* columns, and the withheld rest with its reason."""
    same = F.col("confidence").eqNullSafe(F.lit(confidence))
    primary = joined.filter(same).withColumns(
        {
            "provisional_label": F.col("phase_label"),
            "provisional_confidence": F.col("confidence"),
            "provisional_source": F.col("annotation_source"),
            "provisional_version": F.col("annotation_version"),
            "source_relative_path": F.col("relative_path"),
        }
    )
    withheld = joined.filter(~same).withColumn(
        "prepared_exclusion_reason", F.lit(f"confidence_not_{confidence}")
    )
    return primary, withheld


def fold_views(df: DataFrame, folds: int = 5) -> DataFrame:
    """Each development row is train in folds-1 views and validation in one; test rows are in all."""
    views = df.withColumn("fold_view", F.explode(F.array(*[F.lit(k) for k in range(folds)])))
    role = (
        F.when(F.col("split") == "test", "test")
        .when(F.col("fold") == F.col("fold_view"), "validation")
        .otherwise("train")
    )
    return views.withColumn("prepared_role", role)


def prepared_views(primary: DataFrame, folds: int = 5) -> DataFrame:
    """Fold views with their destination paths; the common part of a path is built once per sample."""
    names = ["provisional_label", "subject_id", "condition", "sample_id", "source_relative_path"]
    tail = ids.destination_tail(*[F.col(c) for c in names])
    views = fold_views(primary.withColumn("_tail", tail), folds)
    path = ids.destination(F.col("prepared_role"), F.col("fold_view"), F.col("_tail"))
    return views.withColumn("relative_path", path).drop("_tail")


def view_digests(primary: DataFrame, folds: int = 5, checksum: str = "sha256") -> DataFrame:
    """Digest of every view (train and validation of each fold, test) over its paths and checksums.

    A path inside a view is the same in all views, so each file is digested once, into one sum per
    split and fold; the views' sums are sums of those few rows. The test view counts once.
    """
    names = ["provisional_label", "subject_id", "condition", "sample_id", "source_relative_path"]
    tail = ids.destination_tail(*[F.col(c) for c in names])
    files = primary.select("split", "fold", ids.line_hash(tail, checksum).alias("_line"))
    parts = files.groupBy("split", "fold").agg(F.count(F.lit(1)).alias("entries"), *ids.word_sums(F.col("_line")))
    own = F.when(F.col("split") == "test", F.array(F.lit("test"))).otherwise(
        F.array(*[F.concat(F.lit(f"fold_{k}/"), F.when(F.col("fold") == k, "validation").otherwise("train")) for k in range(folds)])
    )
    return _summed(parts.withColumn("view", F.explode(own)))


def prepared_digests(views: DataFrame, path: str = "relative_path", checksum: str = "sha256") -> DataFrame:
    """Digest of all rows of the prepared views (``all``), and of each view's roles, over whole destination paths.

    Every row of every view is a line of its own: a test row counts in each view that lists it.
    """
    view = F.concat(F.lit("fold_"), F.col("fold_view").cast("string"), F.lit("/"), F.col("prepared_role"))
    lines = views.select(view.alias("view"), ids.line_hash(path, checksum).alias("_line"))
    parts = lines.groupBy("view").agg(F.count(F.lit(1)).alias("entries"), *ids.word_sums(F.col("_line")))
    return _summed(parts.withColumn("view", F.explode(F.array(F.lit("all"), F.col("view")))))


def _summed(parts: DataFrame) -> DataFrame:
    """Digest of each view from its parts' numbers of lines and word sums."""
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ids.WORD_NAMES]
    views = parts.groupBy("view").agg(F.sum("entries").alias("entries"), *sums)
    return views.select("view", "entries", ids.digest_of().alias("digest"))


def fold_view_summary(views: DataFrame) -> DataFrame:
    return views.groupBy("fold_view", "prepared_role").agg(
        F.count(F.lit(1)).alias("frames"), F.count_distinct("subject_id").alias("subjects")
    )
