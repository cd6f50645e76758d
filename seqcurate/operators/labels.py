"""Cycle grid, phase labels, cycle boundaries and sequence QC.

The grid is never materialised as one array per sequence. Each frame finds the cell that
holds it from its nearest peaks and a few per-sequence numbers, in closed form; grid points
and cycles are the distinct cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import blocks

MAX_GAP = 1.65
MIN_STEP = 7
GATE_CV = 0.30


def sequence_stats(frames: DataFrame, peaks: DataFrame, keys, order: str, feature: str, default_step: Column):
    """One row per sequence: span, missing features, peak steps, method and confidence."""
    steps = blocks.carry(peaks.select(*keys, order), keys, order, last={"_prev": F.col(order)}, inclusive=False, rising=True)
    gap = F.col(order) - F.col("_prev")
    peak_side = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detected_contact_count"),
        F.min(order).alias("_g0"),
        F.max(order).alias("_gn"),
        F.percentile(gap, F.lit(0.5)).alias("_median"),
        F.stddev_pop(gap).alias("_std"),
    )
    frame_side = frames.withColumn("_default", default_step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.min(order).alias("first_frame"),
        F.max(order).alias("last_frame"),
        F.count_if(F.col(feature).isNull()).alias("missing_feature_frames"),
        F.min("_default").alias("_default"),
    )
    out = frame_side.join(peak_side, keys, "left")
    found = F.coalesce("detected_contact_count", F.lit(0)) >= 3
    median = F.when(found, F.col("_median")).otherwise(F.col("_default").cast("double"))
    spread = F.when(found, F.col("_std") / F.col("_median")).otherwise(F.lit(1.0))
    return out.select(
        *keys,
        "frame_count",
        "first_frame",
        "last_frame",
        "missing_feature_frames",
        F.coalesce("detected_contact_count", F.lit(0)).cast("bigint").alias("detected_contact_count"),
        F.coalesce("_g0", "first_frame").alias("_g0"),
        F.when(found, F.col("_gn")).otherwise(F.coalesce("_g0", "first_frame")).alias("_gn"),
        median.alias("_median"),
        spread.alias("_cv"),
        F.greatest(F.lit(MIN_STEP), F.bround(median)).cast("bigint").alias("_step"),
        F.when(found, "detected_contacts").otherwise("condition_cycle_prior").alias("coverage_method"),
        F.when(found & (spread <= GATE_CV), "medium").otherwise("low").alias("confidence"),
    )


def locate(frames: DataFrame, peaks: DataFrame, stats: DataFrame, keys, order: str) -> DataFrame:
    """Add ``cell_start``/``cell_end`` (half-open) and the sequence's stats to every frame."""
    rows = frames.withColumn("_kind", F.lit(1)).withColumn("_peak", F.lit(None).cast("bigint"))
    marks = peaks.select(*keys, order, F.lit(0).alias("_kind"), F.col(order).alias("_peak"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    near = blocks.carry(
        both,
        keys,
        order,
        last={"_a": F.col("_peak")},
        first={"_b": F.col("_peak")},
        tie=("_kind",),
        rising=True,
        attach=stats,
    ).filter("_kind = 1")

    at, step = F.col(order), F.col("_step")
    outside = lambda anchor: anchor + F.floor((at - anchor) / step) * step
    a, gap = F.col("_a"), F.col("_b") - F.col("_a")
    pieces = F.when(gap > MAX_GAP * step, F.greatest(F.lit(2), F.bround(gap / step))).otherwise(1).cast("bigint")
    point = lambda k: F.bround(a + gap * k / F.col("_pieces")).cast("bigint")
    near = near.withColumn("_pieces", pieces)
    near = near.withColumn("_k0", F.floor((at - a) * F.col("_pieces") / gap))
    near = near.withColumn("_k", F.when(point(F.col("_k0") + 1) <= at, F.col("_k0") + 1).otherwise(F.col("_k0")))
    prior = F.col("coverage_method") == "condition_cycle_prior"
    low = (prior | (at < F.col("_g0")))
    start = (
        F.when(low, outside(F.col("_g0")))
        .when(at >= F.col("_gn"), outside(F.col("_gn")))
        .otherwise(point(F.col("_k")))
    )
    end = F.when(low | (at >= F.col("_gn")), start + step).otherwise(point(F.col("_k") + 1))
    out = near.withColumn("cell_start", start.cast("bigint")).withColumn("cell_end", end.cast("bigint"))
    return out.drop("_kind", "_peak", "_a", "_b", "_pieces", "_k0", "_k")


def progress(order: str) -> Column:
    share = (F.col(order) - F.col("cell_start")) / (F.col("cell_end") - F.col("cell_start"))
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(0.999999))


def phase_from_progress(value: Column, thresholds=S.PHASE_THRESHOLDS) -> Column:
    """Ordinal of the phase a cycle position falls in (left-closed)."""
    out = F.when(value < thresholds[0], 0)
    for index, limit in enumerate(thresholds[1:], 1):
        out = out.when(value < limit, index)
    return out.otherwise(len(thresholds))


def assign(located: DataFrame, order: str = "frame_index", version: str = "v0") -> DataFrame:
    """Frame labels from located frames."""
    share = progress(order)
    index = phase_from_progress(share)
    return (
        located.withColumn("phase_index", index)
        .withColumn("phase_label", S.phase_name(F.col("phase_index")))
        .withColumn("cycle_position", F.bround(share, 6))
        .withColumn("annotation_source", F.lit(S.ANNOTATION_SOURCE))
        .withColumn("annotation_version", F.lit(version))
    )


def marks(start: Column, end: Column, thresholds=S.PHASE_THRESHOLDS) -> list[Column]:
    """Inner boundaries: the first whole frame at or past each threshold, at least k frames in."""
    length = end - start
    return [
        start + F.greatest(F.lit(k), F.ceil(length * F.lit(limit))).cast("bigint")
        for k, limit in enumerate(thresholds, 1)
    ]


def cells(located: DataFrame, keys, extra=()) -> DataFrame:
    """Distinct grid cells; frames collapse to cells before the shuffle. ``extra`` is fixed per sequence."""
    return located.select(*keys, "cell_start", "cell_end", *extra).distinct()


def grid(located: DataFrame, keys) -> DataFrame:
    """Grid points: all cell starts and the end of the last cell."""
    both = F.explode(F.array("cell_start", "cell_end")).alias("grid_frame")
    return cells(located, keys).select(*keys, both).distinct()


def boundaries(located: DataFrame, keys, identity=("dataset", "subject_id"), version: str = "v0") -> DataFrame:
    """Complete cycles inside the observed span, numbered over all grid cells."""
    carried = [*identity, "confidence", "first_frame", "last_frame"]
    all_cells = cells(located, keys, carried)
    numbered = blocks.rank(all_cells, keys, ["cell_start"], blocks.block_of(F.col("cell_start")), "_number")
    whole = numbered.filter("cell_start >= first_frame and cell_end <= last_frame")
    inner = marks(F.col("cell_start"), F.col("cell_end"))
    number = (F.col("_number") + 1).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return whole.select(
        *identity,
        *keys,
        F.concat(F.lit("step_"), padded).alias("cycle_id"),
        F.col("cell_start").alias("contact_start_frame"),
        inner[0].alias("mid_stance_frame"),
        inner[1].alias("terminal_stance_frame"),
        inner[2].alias("swing_frame"),
        F.col("cell_end").alias("next_contact_frame"),
        "confidence",
        F.lit(S.ANNOTATION_SOURCE).alias("annotation_source"),
        F.lit(version).alias("annotation_version"),
        F.lit(S.BOUNDARY_NOTE).alias("notes"),
    )


def qc(frames: DataFrame, stats: DataFrame, keys, eligible: Column, identity=()) -> DataFrame:
    """Per-sequence quality table; identity columns have one value per sequence."""
    own = frames.groupBy(*keys, *identity).agg(F.count_if(eligible).alias("eligible_frame_count"))
    out = own.join(stats, keys)
    return out.select(
        *identity,
        *keys,
        "frame_count",
        "detected_contact_count",
        F.bround("_median", 4).alias("median_step_frames"),
        F.bround("_cv", 6).alias("step_interval_cv"),
        "coverage_method",
        "confidence",
        "missing_feature_frames",
        "eligible_frame_count",
    )


def exclusion_ledger(manifest: DataFrame, labelled: DataFrame, dataset_reasons: dict[str, str], default: str):
    """Every manifest row without a label, with its reason."""
    left = manifest.join(labelled.select("sample_id"), "sample_id", "left_anti")
    reason = F.coalesce("exclusion_reason", F.lit(default))
    for dataset, text in dataset_reasons.items():
        reason = F.when(F.col("dataset") == dataset, text).otherwise(reason)
    return left.withColumn("provisional_exclusion_reason", reason)


def split_summary(labels: DataFrame) -> DataFrame:
    return labels.groupBy("split", "fold", "phase_label").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_distinct("subject_id").alias("subjects"),
        F.count_distinct("sequence_id").alias("sequences"),
    )


def value_counts(labels: DataFrame, *columns: str) -> DataFrame:
    """Counts of several categorical columns in one pass, in long form."""
    kinds = ", ".join(f"'{c}', cast({c} as string)" for c in columns)
    long = labels.selectExpr(f"stack({len(columns)}, {kinds}) as (kind, value)")
    return long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("frames"))


def expand(bounds: DataFrame, carried, boundary_columns, label: str = "label", order: str = "frame_index"):
    """Five boundaries to one row per frame, half-open intervals, empty ones skipped."""
    names = list(boundary_columns)
    pairs = ", ".join(f"{i}, {names[i]}, {names[i + 1]}" for i in range(4))
    parts = bounds.selectExpr(*carried, f"stack(4, {pairs}) as (_phase, _from, _to)")
    rows = blocks.explode_span(parts, F.col("_from"), F.col("_to"), order)
    return rows.select(*carried, order, S.phase_name(F.col("_phase")).alias(label))


def compare(labels: DataFrame, bounds: DataFrame, columns=S.MACHINE_MARKS) -> DataFrame:
    """Frame labels against saved boundaries, frame by frame, on integer keys."""
    saved = expand(bounds, ["sequence_id", "cycle_id"], columns, "boundary_phase")
    return labels.join(saved, ["sequence_id", "frame_index"])


def overlaps(bounds: DataFrame, columns=S.MACHINE_MARKS) -> DataFrame:
    """Frames claimed by more than one saved cycle (must be empty)."""
    saved = expand(bounds, ["sequence_id", "cycle_id"], columns, "boundary_phase")
    return saved.groupBy("sequence_id", "frame_index").count().filter("count > 1")


def repair(bounds: DataFrame) -> DataFrame:
    """Recompute the inner boundaries from the cycle span; flag the changed records."""
    start, _, _, _, stop = S.MACHINE_MARKS
    inner = marks(F.col(start), F.col(stop))
    names = S.MACHINE_MARKS[1:4]
    changed = F.lit(False)
    for name, value in zip(names, inner):
        changed = changed | ~F.col(name).eqNullSafe(value)
    out = bounds.withColumn("changed", changed)
    return out.withColumns(dict(zip(names, inner)))


def boundary_flags(df: DataFrame, keys=("sequence_id",), order="frame_index", label="y_true", name="y_boundary"):
    """1 where the label differs from the previous frame of the same sequence (frame - 1 only)."""
    keys = list(keys)
    rows = blocks.spread(blocks.halo(df, order, 1, 0), keys)
    w = blocks.per_block(keys).orderBy(order)
    moved = (F.lag(order).over(w) == F.col(order) - 1) & (F.lag(label).over(w) != F.col(label))
    return blocks.core(rows.withColumn(name, F.coalesce(moved, F.lit(False)).cast("int"))).drop(blocks.BLOCK)
